import pytest

from waymark.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", 8)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
