"""``python -m waymark``: list queries and experiments, check the setting, run a query.

``run`` and ``experiment`` only say what they would do unless ``--execute`` is given.
"""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys


def doctor(sf_dir: str) -> list[str]:
    """What is missing for running the queries; empty if nothing is."""
    missing = [f"module {m}" for m in ("pyspark", "pyarrow", "numpy", "pandas") if importlib.util.find_spec(m) is None]
    tables = ("embeddings", "events", "lineitem", "pages")
    return missing + [f"table {sf_dir}/{t}.parquet" for t in tables if "://" not in sf_dir and not os.path.exists(f"{sf_dir}/{t}.parquet")]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="waymark", description=__doc__)
    sub = parser.add_subparsers(dest="verb", required=True)
    sub.add_parser("list")
    for verb in ("doctor", "run", "experiment"):
        p = sub.add_parser(verb)
        if verb != "doctor":
            p.add_argument("name")
            p.add_argument("--execute", action="store_true")
            p.add_argument("--out")
        p.add_argument("--sf", default="/root/testdata/sf0.001")
    given = parser.parse_args(args)
    from waymark.plans.studies import EXPERIMENTS, streams_of
    from waymark.queries import QUERIES

    if given.verb == "list":
        print(*[f"query {n}" for n in sorted(QUERIES)], *[f"experiment {n}: {', '.join(e.arms)}" for n, e in sorted(EXPERIMENTS.items())], sep="\n")
        return 0
    if given.verb == "doctor":
        missing = doctor(given.sf)
        print(*(missing or ["nothing is missing"]), sep="\n")
        return int(bool(missing))
    known = QUERIES if given.verb == "run" else EXPERIMENTS
    if given.name not in known:
        print(f"no {given.verb} named {given.name}", file=sys.stderr)
        return 2
    if not given.execute:
        print(f"would {given.verb} {given.name} on {given.sf}" + (f" into {given.out}" if given.out else ""))
        return 0
    from waymark.session import session

    spark = session("waymark", os.environ.get("SPARK_MASTER", "local[*]"))
    if given.verb == "run":
        df = QUERIES[given.name](spark, given.sf)
    else:
        from waymark.catalog import vectors as v
        from waymark.operators import knn, search

        p = v.points(spark, given.sf)
        q = v.searched(p)
        truth = knn.nearest(v.as_points(q), p, v.TOP, exclude_self=False)
        df = search.summary(search.replay(q, v.index_of(p), streams_of(given.name, v.WIDTHS)), truth, v.TOP)
    df.write.mode("error").parquet(given.out) if given.out else df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
