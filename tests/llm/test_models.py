import itertools
import os
import zlib

import numpy as np
import pytest

from waymark.llm import base, langid, quality, toxicity, trees

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in langid.initial(3, 4, 1).items()}
    x, y = rng.integers(97, 102, (7, 5)), np.array([0, 1, 2, 1, 0])
    _, grad = langid.gradients(net, x, y)
    for name, at in (("f.ur", (1, 2)), ("f.un", (0, 3)), ("b.uz", (2, 1)), ("b.xn", (98, 1)), ("f.xr", (99, 0)), ("o", (5, 1)), ("c", (2,))):
        old = net[name][at]
        net[name][at] = old + 1e-5
        up = langid.gradients(net, x, y)[0]
        net[name][at] = old - 1e-5
        down = langid.gradients(net, x, y)[0]
        net[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_language_windows_and_batches_do_not_matter():
    net = langid.initial(3, 4, 2)
    texts = ["a", "b" * 300, "", None, "c" * 128, "d" * 129]
    both = langid.document_probabilities(net, texts)
    for k, t in enumerate(texts):
        assert langid.document_probabilities(net, [t])[0] == pytest.approx(both[k], abs=1e-5)
    assert both[2].sum() == 0 and both[[0, 1, 4, 5]].sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "12 ½ ² _!", "1 a", "é", "日")] == [False, False, False, True, True, True]


def test_language_of_odd_rows(odd, none):
    model = langid.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20, epochs=2)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()]
    assert len(got) == 10 and {i for i, p in got if p == "und"} == {2, 3, 4, 7}
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.predictions(none.unionByName(odd.where("lang is null"))).collect()} == {"und"}
    kept = langid.known(odd, model, over_chance=0.0)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 5, 6, 8}


@tables
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.96


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = trees.boost(x[:400], y[:400])
    assert ((model.margin(x[400:]) > 0) == y[400:]).mean() > 0.93
    knots, levels = trees.isotonic(np.array([0, 1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all() and 0 < levels[0] < levels[-1] < 1
    assert trees.boost(x[:5], np.zeros(5)).trees == []


def test_toxicity_of_odd_rows(odd, none):
    rows = [(k, "you fool " * 3 + f"w{k}", 1) for k in range(20)] + [(100 + k, f"a calm text w{k}", 0) for k in range(60)]
    model = toxicity.fit(rows)
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and max(got.values()) < 0.5
    assert toxicity.score(none, model).count() == 0
    kept = toxicity.clean(odd.unionByName(odd.limit(1).selectExpr("99L as doc_id", "'you fool' as text", *odd.columns[2:])), model)
    assert kept.columns == odd.columns and kept.count() == 10
    assert toxicity.score(odd, toxicity.fit([])).count() == 10


def test_obfuscation_and_proximity():
    memo = toxicity.Memo(toxicity.Lexicon({"idiot": 2.0}, {"lowe": 1.0}))
    x = dict(zip(toxicity.NAMES, toxicity.features(["You 1d1ot !", "idiot", "Loweschaft", None], memo).T, strict=True))
    assert x["word hits"].tolist() == [1, 1, 0, 0] and x["near second person"].tolist() == [1, 0, 0, 0]
    assert x["stem hits"].tolist() == [0, 0, 1, 0] and x["obfuscated"][0] > 0 and x["capitals"][2] > 0


@tables
def test_toxicity_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.predictions(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert sum(r.predicted for r in held if not r.toxic) == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([1, 4, 3])
    unary, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    bad, at, joint = quality.marginals(unary, moves, counts, pairs=True)
    start = 0
    for n in counts:
        weight, single = 0.0, np.zeros(n)
        pair = np.zeros((max(n - 1, 0), 2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[start + k] * s for k, s in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            weight += w
            single += w * np.array(path)
            for k, (a, b) in enumerate(itertools.pairwise(path)):
                pair[k, a, b] += w
        assert bad[start : start + n] == pytest.approx(single / weight)
        own = (at >= start) & (at < start + n)
        assert joint[own] == pytest.approx(pair / weight)
        start += n


def test_quality_of_odd_rows(odd, none):
    model = quality.fit([(k, "good plain words here\nand more of them", 1) for k in range(30)] + [(k, "BAD!! BAD!! BAD!! BAD!!\n### $$$ ###", 0) for k in range(30)])
    got = quality.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    p = quality.probabilities(model, ["good plain words", "BAD!! BAD!! BAD!!", "", None])
    assert p[0] > 0.7 and p[1] < 0.3 and p[2] == p[3]
    assert quality.score(none, model).count() == 0 and quality.probabilities(quality.fit([]), ["x"])[0] > 0.3


@tables
def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.predictions(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_labels_that_are_neither_0_nor_1_are_ignored(spark):
    """Odd labels, no labels and no documents: training falls back, and every row still has a score."""
    rows = [(k, f"text number {k} of {'fools' if k % 4 == 0 else 'friends'}\nand a line") for k in range(60)] + [(None, None), (61, ""), (62, "long line " * 9000), (5, "text again")]
    docs = spark.createDataFrame([(*r, 1, 0.5, 2) for r in rows], "doc_id long, text string, label int, score double, toxic int")
    labels = spark.createDataFrame([(k, [0, 1, 2, None, -1][k % 5], [0, 1, 7, None, -1][k % 5]) for k in range(60)], "doc_id long, quality int, toxic int")
    for operator, column in ((toxicity, "toxic"), (quality, "quality")):
        found = base.labelled(docs, labels, column, {"1": 50, "0": 50}, 1000)
        assert {r[2] for r in found} <= {0, 1} and len(found) > 10 and max(len(r[1]) for r in found) <= 1000
        for some in (labels, labels.limit(0), labels.where("toxic = 7")):
            got = operator.predictions(docs, some).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert operator.predictions(docs.limit(0), labels).count() == 0


def test_long_training_texts_give_a_part(spark):
    docs = spark.createDataFrame([(3, "abcdefghij" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    (_, part, label), = base.labelled(docs, labels, "toxic", {"1": 5, "0": 5}, 100)
    assert len(part) == 100 and part in "abcdefghij" * 500 and label == 1


def test_documents_equal_a_plain_forward_pass():
    """Byte by byte, in plain Python, both ways, pooled over the document."""
    net = {k: v.astype(float) for k, v in langid.initial(3, hidden=3).items()}
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def states(d, raw):
        h, out = np.zeros(3), []
        for b in raw:
            r = logistic(net[f"{d}.xr"][b] + h @ net[f"{d}.ur"])
            z = logistic(net[f"{d}.xz"][b] + h @ net[f"{d}.uz"])
            n = np.tanh(net[f"{d}.xn"][b] + r * (h @ net[f"{d}.un"]))
            h = z * h + (1 - z) * n
            out.append(h)
        return out

    texts = ["ein kurzer Text", "é", "x" * (langid.WINDOW + 37), "", None]
    got = langid.document_probabilities({k: v.astype(np.float32) for k, v in net.items()}, texts)
    for t, p in zip(texts, got, strict=True):
        raw, want = (t or "").encode(), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            for f, b in zip(states("f", part), states("b", part[::-1])[::-1], strict=True):
                e = np.exp(np.concatenate([f, b]) @ net["o"] + net["c"])
                want += e / e.sum()
        assert np.allclose(p, want / max(1, len(raw)), atol=1e-5)
