import hashlib
import random
import zlib

import numpy as np
import pytest

from waymark.llm import media, sampling, warc, webp, wordpiece


def picture(h, w, colours=None):
    rng = np.random.default_rng(h * w)
    y, x = np.mgrid[:h, :w]
    c = np.stack([np.full((h, w), 255), (x * 3 + y) % 256, (y * 5 + rng.integers(0, 3, (h, w))) % 256, (x * y) % 256], -1)
    p = webp._pixels(c.astype(np.int32))
    return p if colours is None else np.unique(p)[:colours][rng.integers(0, min(colours, len(np.unique(p))), (h, w))]


TOOLS = [dict(), dict(subtract_green=True), *[dict(predictor=m) for m in range(14)], dict(cross=(17, -33, 120)), dict(cache_bits=6), dict(references=True), dict(groups=True), dict(predictor=11, cross=(5, 6, -7), subtract_green=True, cache_bits=4, references=True, groups=True)]


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 1), (13, 19)])
@pytest.mark.parametrize("tools", TOOLS, ids=str)
def test_pictures_come_back(shape, tools):
    p = picture(*shape)
    assert (webp.decode(webp.encode(p, webp.Tools(**tools))) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 120])
def test_palettes_come_back(colours):
    p = picture(9, 23, colours)
    for more in (dict(), dict(references=True, cache_bits=3)):
        assert (webp.decode(webp.encode(p, webp.Tools(palette=True, **more))) == p).all()


def test_a_known_file():
    """One opaque pixel, written by hand from the format: five single-symbol codes."""
    bits = [(0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for value in (0x40, 0x20, 0x60, 0xFF):
        bits += [(1, 1), (0, 1), (1, 1), (value, 8)]
    bits += [(1, 1), (0, 1), (0, 1), (0, 1)]
    word = n = 0
    for v, size in bits:
        word |= v << n
        n += size
    assert webp.decode(webp._wrap(word.to_bytes((n + 7) // 8, "little"))).tolist() == [[0xFF204060]]


def test_damage_is_an_error():
    good = webp.encode(picture(13, 19))
    for bad in (b"", good[:30], b"RIFX" + good[4:], good[:20] + b"\x2e" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    assert len(webp.near_offsets()) == 120 and webp.near_offsets()[:4] == ((0, 1), (1, 0), (1, 1), (-1, 1))


PAYLOADS = ["", "a", "x" * 575, "y" * 576, "\n".join(["line of text that is long enough to be copied " * 2] * 40), "".join(map(chr, range(1, 1500))), "ab" * 5000]


@pytest.mark.parametrize("text", PAYLOADS, ids=range(len(PAYLOADS)))
def test_payloads_come_back(text):
    raw, n = media.payload(text)
    assert len(raw) % 576 == 0 and len(raw) and raw[:n] == text.encode()
    assert webp.decode_payload(webp.encode_payload(raw, n)).tobytes() == raw


def plain_greens(bits, codes, total, width):
    """Code by code, without tables."""
    green, red, blue, alpha, far = codes
    out = []
    while len(out) < total:
        symbol = green.read(bits)
        if bits.at > bits.end:
            raise ValueError
        if symbol < 256:
            out.append(alpha.single << 24 | red.single << 16 | symbol << 8 | blue.single)
        else:
            n = webp._prefixed(bits, symbol - 256)
            d = webp._true_distance(webp._prefixed(bits, far.read(bits)), width)
            for _ in range(n):
                out.append(out[-d])
    return np.array(out, np.uint32)


def many_kinds():
    """Payloads that take back-references, each predictor, bundles, and all 256 values with copies."""
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 576 * 3, dtype=np.uint8)
    line = bytes(rng.integers(32, 250, 200, dtype=np.uint8)).replace(b"\n", b"_")
    skewed = bytes(np.minimum(rng.geometric(0.3, 576 * 4), 200).astype(np.uint8))
    return {
        "ramp": bytes(np.cumsum(rng.integers(0, 3, 576 * 4)).astype(np.uint8)),
        "columns": bytes((np.tile(rng.permutation(576) % 251, (9, 1)) + rng.integers(0, 2, (9, 576))).astype(np.uint8)),
        "skewed": skewed,
        "lines": b"\n".join([line, skewed[:150], line, bytes(set(range(256)) - {10}), line]).ljust(576 * 3, b"\xff"),
        "noise": bytes(noise),
        "two": bytes(rng.integers(0, 2, 576 * 2, dtype=np.uint8)),
        "nine": bytes(rng.integers(0, 9, 576 * 2, dtype=np.uint8)),
        "one": b"\0" * 576,
    }


@pytest.mark.parametrize("kind", many_kinds())
@pytest.mark.parametrize("stretch", [8, 100, 1 << 14])
def test_tables_equal_reading_code_by_code(kind, stretch, monkeypatch):
    raw = many_kinds()[kind]
    data = webp.encode_payload(raw)
    monkeypatch.setattr(webp, "STRETCH", stretch)
    assert webp.decode_payload(data).tobytes() == raw
    monkeypatch.setattr(webp, "_read_greens", plain_greens)
    assert webp.decode_payload(data).tobytes() == raw


def test_predictors_are_chosen_by_cost(monkeypatch):
    chosen = {}
    real = webp._cheapest
    for kind, raw in many_kinds().items():
        monkeypatch.setattr(webp, "_cheapest", lambda index, kind=kind: chosen.setdefault(kind, real(index)))
        webp.encode_payload(raw)
    assert chosen["ramp"][0] == 1 and chosen["columns"][0] == 2 and chosen["skewed"][0] is None and chosen["noise"][0] is None


def test_codes_have_many_lengths(monkeypatch):
    seen = []
    monkeypatch.setattr(webp, "write_code", lambda sink, lengths, real=webp.write_code: seen.append(lengths) or real(sink, lengths))
    raw, n = media.payload("a text whose letters are more and less frequent, as in any prose " * 20 + "qxz")
    webp.encode_payload(raw, n)
    assert len(set(seen[-5].values())) > 3


def test_damaged_payloads_fail_or_differ():
    raw = many_kinds()["skewed"]
    data = webp.encode_payload(raw)
    short = data[: len(data) // 2]
    with pytest.raises(ValueError):
        webp.decode(short)
    body = short[:16] + (len(short) - 20).to_bytes(4, "little") + short[20:]
    with pytest.raises(ValueError):
        webp.decode(body)


def test_large_payloads_are_several_files(monkeypatch):
    monkeypatch.setattr(webp, "ROWS", 4)
    raw = bytes(np.random.default_rng(0).integers(97, 120, 576 * 11, dtype=np.uint8))
    data = webp.encode_payload(raw, len(raw) - 700)
    assert len(webp.images(data)) == 3 and webp.decode_payload(data).tobytes() == raw
    padded = raw[:-700] + b"\xff" * 700
    assert webp.decode_payload(webp.encode_payload(padded, len(raw) - 700)).tobytes() == padded


def test_media_facts(odd, none):
    got = media.facts(odd).collect()
    assert len(got) == 10 and media.facts(none).count() == 0
    for r in got:
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id)
        raw, n = media.payload(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        data = webp.encode_payload(raw, n)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    stored = media.store(odd.where("doc_id < 6"))
    for r in media.pixels(stored).collect():
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id)
        assert bytes(v >> 8 & 255 for v in r.argb) == media.payload(text)[0] and r.width == 576


# --- archives ---


def test_url_keys():
    assert warc.url_key("HTTP://user@www.Example.org:8080/a b?q=1#frag") == "org,example,www:8080)/a%20b?q=1"
    assert warc.url_key(None) == ")/" and warc.url_key("x y") == ")x%20y"


def test_records():
    raw = warc.record(7, "http://a/b", "<p>é</p>".encode(), None)
    i, n, d, kind, origin, uri = warc.facts(warc.parse(raw))
    assert (i, n, d, kind, origin, uri) == (7, 9, warc.digest("<p>é</p>".encode()), "response", None, "http://a/b")
    again = warc.facts(warc.parse(warc.record(8, None, "<p>é</p>".encode(), 7)))
    assert again[:5] == (8, 9, d, "revisit", 7)
    with pytest.raises(Exception):
        warc.parse(raw[:-9])


def test_round_trip(spark):
    rows = [(k, None if k == 3 else f"http://{'hot' if k % 3 else f'h{k}'}.example.com/{k % 50}", None if k % 17 == 0 else f"<p>{'same' if k % 5 == 0 else k}</p>") for k in range(400)]
    rows += [(None, "http://x/", "<p>1</p>"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, html in rows:
        first = min(j for j, _, h in rows if (h or "") == (html or "") and j is not None)
        raw = (html or "").encode()
        want.append((i, len(raw), warc.digest(raw), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_search(spark):
    rows = [(k, f"http://h{k % 7}/{k}", b"x") for k in range(900)]
    pages = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, payload binary, refers_to long")
    archive = warc.write(pages, block=16)
    assert [s[:3] for s in archive.shards] == sorted(s[:3] for s in archive.shards) and len(archive.shards) > 1
    reader = warc.Reader(archive)
    for k in (0, 1, 450, 899):
        name, offset, size = reader.locate(warc.url_key(rows[k][1]), k, hashlib.sha1(b"x").hexdigest())
        assert warc.facts(warc.parse(reader.read(name, offset, size)))[0] == k
        assert [*reader.captures(warc.url_key(rows[k][1]), k)] == [(name, offset, size)]
    assert reader.locate("zzz)/", 1, "") is None and reader.locate("", 1, "") is None and not [*reader.captures("zzz)/", 1)]
    missing = spark.createDataFrame([(1, "http://h1/1"), (2, "http://none/")], "page_id long, url string")
    assert [r.page_id for r in warc.read(missing, archive).collect()] == [1]


def test_records_of_one_url_and_id_are_told_apart(spark):
    """Repeated keys with different payloads, very many equal rows, clashing columns, a very long page."""
    rows = [(7, "http://y/", "AAA"), (7, "http://y/", "BBBB"), (None, "http://x/", "<p>1</p>"), (None, "http://x/", "<p>two</p>"), (7, "http://y/", "AAA"), (1, None, "é" * 700_000), (2, None, None)]
    rows += [(9, "http://hot/", f"{k % 3}") for k in range(300)]
    df = spark.createDataFrame([(*r, 1, "k", 5) for r in rows], "page_id long, url string, html string, id int, key string, offset int").repartition(4)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in warc.round_trip(df).collect())
    assert got == sorted((str(i), len((h or "").encode()), warc.digest((h or "").encode())) for i, _, h in rows)
    archive = warc.write(warc.with_origin(warc.named(df)), block=7)
    both = spark.createDataFrame([(7, "http://y/"), (9, "http://hot/"), (8, "http://y/")], "page_id long, url string")
    assert sorted(r.page_id for r in warc.read(both, archive).collect()) == [7] * 3 + [9] * 300


# --- pieces ---


def greedy(first, rest, word):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first)), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy_search():
    rng = random.Random(0)
    some = lambda k: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(k)}
    for _ in range(150):
        first, rest = some(rng.randint(1, 12)), some(rng.randint(1, 12))
        a = wordpiece.Automaton(sorted(first), sorted(rest))
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            assert a.count(word) == greedy(first, rest, word)


def test_token_counts(odd, none):
    first, rest = map(set, wordpiece.vocabulary(wordpiece.default_path()))
    for r in wordpiece.count_tokens(odd).collect():
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id)
        n = [greedy(first, rest, w) for w in wordpiece.WORD.findall(text or "")[:40_000]]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(n), sum(abs(x) for x in n), sum(x < 0 for x in n))
    assert wordpiece.count_tokens(none).count() == 0


def test_sampled_pieces_are_lossless_and_reproducible(odd, none):
    m = sampling.model(sampling.default_path())
    rng = random.Random(3)
    some = ["a", " ", " " * 18, "▁", "é", "日本", "\U0001F44D\U0001F3FD", "\n", "\t", "\0", "x" * 200, "the", "\x85", "́"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    ids = sampling.encode(m, texts, np.arange(800))
    assert [sampling.decode(m, i).decode() for i in ids] == texts
    again = sampling.encode(m, texts[300:303], np.arange(300, 303))
    assert all((a == b).all() for a, b in zip(again, ids[300:303], strict=True))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(sampling.encode(m, ["unbelievable things"] * 40, np.arange(40)), sampling.encode(m, ["unbelievable things"] * 40, np.arange(40, 80)), strict=True))
    got = sampling.facts(odd).collect()
    assert len(got) == 10 and all(r.lossless for r in got) and sampling.facts(none).count() == 0
    back = {r.doc_id: r.text for r in sampling.texts_of(sampling.segmentations(odd.where("doc_id < 8"))).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id and r.doc_id < 8}


def test_long_segments_are_one_lattice(monkeypatch):
    """Words over any cut: pieces cross every place, draws equal the whole lattice's, the mean length is exact."""
    m = sampling.model(sampling.default_path())
    keys = sampling.mix(np.arange(40, dtype=np.uint64))
    monkeypatch.setattr(sampling, "PART", 37)
    for word in (" " + "international" * 20, "é日本\U0001F44D" * 30, "x" * 301, " " * 25 + "https://a.b/c?d=e&f=" * 9):
        lattice = sampling.Lattice(m, [word])
        for k in range(6):
            whole, _ = lattice.draw(np.zeros(1, np.int64), keys[k : k + 1])
            assert sampling.draw_long(m, word, keys[k : k + 1]).tolist() == whole.tolist()
    word = "international" * 8
    covered = np.zeros(len(word) + 1, bool)
    for i in sampling.encode(m, [word] * 400, np.arange(400)):
        ends = np.cumsum([len(m.bytes[p]) for p in i.tolist()]) - 1
        covered |= ~np.isin(np.arange(len(word) + 1), ends)
    assert covered[60:70].all()
    # Expected number of pieces by a plain recurrence over (weight, weight times pieces).
    raw = b" " + word.encode()
    total = [(1.0, 0.0)]
    for end in range(1, len(raw) + 1):
        w = n = 0.0
        for i, p in enumerate(m.bytes):
            if p and i >= 259 and len(p) <= end and raw[end - len(p) : end] == p:
                a, b = total[end - len(p)]
                w, n = w + a * np.exp(m.weight[i]), n + (a + b) * np.exp(m.weight[i])
        total.append((w, n))
    seen = np.mean([len(x) for x in sampling.encode(m, [word] * 3000, np.arange(3000))])
    assert abs(seen - total[-1][1] / total[-1][0]) < 0.25


def test_stretches_change_nothing(monkeypatch):
    m = sampling.model(sampling.default_path())
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "unbelievable", "x" * 230, "\n", "", "日本語"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    want = [x.tolist() for x in sampling.encode(m, texts, np.arange(40))]
    monkeypatch.setattr(sampling, "STRETCH", 90)
    assert [x.tolist() for x in sampling.encode(m, texts, np.arange(40))] == want
    assert [sampling.decode(m, np.array(x, np.int64)).decode() for x in want] == texts


def test_sampling_follows_the_lattice():
    m = sampling.model(sampling.default_path())

    def paths(raw):
        if not raw:
            return [((), 0.0)]
        return [((i, *q), m.weight[i] + w) for i, p in enumerate(m.bytes) if p and i >= 259 and raw.startswith(p) for q, w in paths(raw[len(p) :])]

    every = paths(b" hello")
    total = sum(np.exp(w) for _, w in every)
    ids, counts = sampling.Lattice(m, [" hello"]).draw(np.zeros(60_000, np.int64), sampling.mix(np.arange(60_000, dtype=np.uint64)))
    seen = {}
    for x in np.split(ids, np.cumsum(counts)[:-1]):
        seen[tuple(x.tolist())] = seen.get(tuple(x.tolist()), 0) + 1
    assert all(abs(seen.get(q, 0) / 60_000 - np.exp(w) / total) < 0.01 for q, w in every) and seen.keys() <= {q for q, _ in every}
