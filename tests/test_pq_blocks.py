from waymark.catalog import vectors
from waymark.operators import pq


def test_scan_takes_any_number_of_queries(spark):
    p = vectors.points(spark, "/root/testdata/sf0.001")
    book = vectors.first_book(p)
    codes = pq.encode(p, book)
    q = p.selectExpr("id as query", "vec").where("id < 60")
    whole = lambda df: sorted(map(tuple, df.collect()))
    want = whole(pq.scan(q, codes, book, k=5))
    assert len({r[0] for r in want}) == q.count() > 7
    assert whole(pq.scan(q, codes, book, k=5, block_rows=7)) == want
    assert pq.scan(q.limit(0), codes, book, block_rows=7).count() == 0
