"""The pipeline against a plain version, stage by stage, on a small folder of its own."""

import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from waymark.llm import langid, queries, toxicity, wordbpe

from .test_resemblance import similarity
from .test_simhash import union

EN = "the committee of this town had decided that all roads should be mended before winter comes"
DE = "der ausschuss dieser stadt hatte beschlossen dass alle strassen vor dem winter ausgebessert werden"


def varied(text, k):
    w = text.split()
    return " ".join(w[(k + j * (k % 5 + 1)) % len(w)] + ("" if j % 3 else str((k * 7 + j) % 10)) for j in range(60))


def backward(text, k):
    return " ".join(reversed(varied(text, k).split()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(k, varied(EN if k % 2 else DE, k), "en" if k % 2 else "de") for k in range(120)]
    toxic = [(200 + k, varied(EN, k) + " you utter scoundrel and villain", "en") for k in range(24)]
    odd = [(300, rows[3][1], "en"), (301, rows[3][1] + " extra", "en"), (302, None, None), (303, "123 456", None), (304, rows[8][1], "de"), (305, backward(EN, 77), "en"), (305, backward(EN, 77), "en"), (305, backward(DE, 78), "de"), (None, backward(EN, 79), "en")]
    path = str(tmp_path_factory.mktemp("sf"))
    every = rows + toxic + odd
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in every], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _, _ in every if i is not None and i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, every


def test_pipeline_equals_a_plain_version(spark, folder):
    path, every = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    lexicon, trees = toxicity.train(docs, labels)
    model = langid.fit(langid.training_rows(docs))
    scores = trees.probability(toxicity.features([r[1] for r in every], toxicity.Memo(lexicon)))
    left = [r for r, x in zip(every, scores, strict=True) if x < 0.5 or not r[1]]
    assert not any(200 <= (r[0] or 0) < 300 for r in left) and len(left) >= 120
    p = langid.document_probabilities(model[1], [r[1] for r in left]).max(axis=1)
    sure = min(langid.OVER_CHANCE / len(model[0]), langid.SURE)
    left = [r for r, x in zip(left, p, strict=True) if r[1] and any(c.isalpha() for c in r[1]) and x >= sure]
    best = {}
    for r in left:
        if r[1] not in best or (best[r[1]][0] or -1) < (r[0] or -1):
            best[r[1]] = r
    left = sorted(best.values(), key=lambda r: (r[0] is None, r[0] or 0))
    roots = union(range(len(left)), [(a, b) for a in range(len(left)) for b in range(a) if similarity(left[a][1], left[b][1]) >= 0.8])
    left = [r for k, r in enumerate(left) if roots[k] == k]
    whole = Tokenizer.from_file(wordbpe.default_path())
    want = sorted(((i, len(whole.encode(t, add_special_tokens=False).ids) + 1) for i, t, _ in left), key=str)
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(((r.doc_id, r.length) for r in got), key=str) == want
    ids = [i for i, _ in want]
    assert not {3, 8, 302, 303} & {*ids} and len(ids) > 20 and ids.count(305) == 2 and None in ids
    assert len({r.sequence_id for r in got}) == -(-sum(n for _, n in want) // 2048)


def test_nothing_to_do(spark, folder, tmp_path):
    """An empty table, and one with clashing extra columns, pass through every stage."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").selectExpr("*", "1L as row", "'x' as label", "2 as __row", "3L as fp", "4 as keep_id", "5 as root")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder[0])
        assert found.columns == docs.columns and found.count() > 20


def test_tables_between_stages_have_small_row_groups(spark, tmp_path, monkeypatch):
    """A task holds a row group whole, so a large partition of texts must not become a single one."""
    docs = spark.range(2000, numPartitions=1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 150), k -> sha2(concat(id, '-', k), 256)), '') as text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("copy", lambda spark, docs, sf_dir: docs.coalesce(1))] * 2)
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2000
    sizes = [group.total_byte_size for part in ds.dataset(f"{tmp_path}/pipeline-copy").get_fragments() for group in part.row_groups]
    assert sum(sizes) > 16 << 20 and max(sizes) < 12 << 20


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "exact dedup", "near dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns


def test_registered():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1
