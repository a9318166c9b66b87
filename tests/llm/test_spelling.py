"""Token counts where the boundary and the bytes are pieces, against a plain greedy search."""

import random

from waymark.llm import queries, wordpiece


def spelled(first, rest, word):
    n = at = 0
    while at < len(word):
        own = first if at == 0 and n == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is not None:
            n, at = n + 1, end
        elif own is first:
            n += 1
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


def test_automaton_equals_a_spelling_search():
    rng = random.Random(1)
    some = lambda k: {"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(k)}
    for _ in range(200):
        first, rest = some(rng.randint(1, 12)), some(rng.randint(0, 12))
        a = wordpiece.Automaton(sorted(first), sorted(rest), True)
        for _ in range(40):
            word = "".join(rng.choice("abé日") for _ in range(rng.randint(0, 12)))
            assert a.count(word) == spelled(first, rest, word), (first, rest, word)


def test_query_leaves_no_word_unknown(spark, tmp_path):
    text = "ñandú 日本 一龥 word " + "日" * 5000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first, rest = map(set, wordpiece.vocabulary(wordpiece.default_path()))
    n = [spelled(first, rest, w) for w in text.split()]
    row = queries.op6_token_counts(spark, str(tmp_path)).first()
    assert n[0] == 4 and n[1] == 3 and (row.n_words, row.n_tokens, row.n_unknown, row.longest_word_tokens) == (5, sum(n), 0, max(n))
