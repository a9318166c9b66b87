"""The corpus pipeline: toxicity, language, exact and near duplicates, then packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. ``run``
writes every stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import dedup, langid, packing, resemblance, toxicity
from waymark.session import shared_dir

#: Bytes of a row group in a stage's table. A task that writes or reads texts holds one whole, on the
#: heap: Parquet's own 128 MB for each core are more than a small heap has.
ROW_GROUP = 8 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts whose calibrated toxicity is a half or more go.

    Null and empty texts stay; repeated rows are judged alike. Without usable labels nothing goes.
    """
    model = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: texts without a letter, or in none of the learned languages, go.

    Null and empty texts have no letter. With fewer than two learned languages all others stay.
    """
    return langid.known(docs, langid.fit(langid.training_rows(_table(spark, sf_dir, "documents"))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts (null counts as empty) one row of the largest id stays."""
    return dedup.mark(docs, single=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of texts linked by five-word similarity 0.8 the smallest id stays.

    Fingerprints of five words within three bits are linked through the vantage-point trees, other
    candidates through MinHash bands, and every link is verified by exact similarity. Texts without a
    word stay; rows are told apart by their place, whatever their ids.
    """
    return resemblance.without_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the kept documents as packed sequences; null and empty texts are one token each."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("packing", pack)]
#: Learned models and a similarity join over shingles are not SQL; brute-force versions test them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the filters and both deduplications keep.

    Extra columns pass through all stages but the last, whatever their names; an empty table gives
    an empty result.
    """
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
