"""The pipeline's language stage with few learned languages."""

import numpy as np
import pytest

import corpus_pipeline
from waymark.llm import langid

TEXTS = [(0, "the roads should be mended before winter"), (1, "la casa es grande"), (2, "short"), (3, None), (4, "123 !"), (5, "the house la casa")]


@pytest.mark.parametrize("langs", [(), ("en",), ("en", "es")])
def test_lettered_texts_stay_whatever_the_labels(spark, tmp_path, langs):
    rows = [(i, t, langs[i % len(langs)] if langs and t and i < 2 else None) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.keep_known_languages(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 5]


def test_two_languages_keep_an_unsure_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "document_probabilities", lambda net, values, width=0: np.tile([0.45, 0.55], (len(values), 1)))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    keep = []
    monkeypatch.setattr(langid, "keep_rows", lambda docs, fn, col: keep.append(fn) or docs)
    langid.known(docs, (["en", "es"], {}))
    assert keep[0]([t for _, t in TEXTS]) == [True, True, True, False, False, True]
