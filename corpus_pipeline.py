"""A corpus pipeline: language, quality, near-duplicates, packing.

``run`` applies the stages one after the other. Each reads what its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huestrata.llm import catalog, language, quality, simhash
from huestrata.llm.common import free_name, on_workers, stored, table
from huestrata.sources.shared import broadcast_if_small, shared_folder

#: A document goes if its language has less than this probability, or its quality less than that.
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, catalog.GOOD_FROM


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; null texts and texts without a letter go."""
    on_workers(spark)
    model = catalog.language_model(spark, sf_dir)
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    found = language.identify(docs, model, lang_pred=lang, score=score)
    sure = (F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE)
    return found.filter(sure).select(docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that op6 predicts to be good."""
    on_workers(spark)
    model = catalog.quality_model(spark, sf_dir)
    score = free_name(docs, "_score")
    found = quality.score_quality(docs, model, score=score)
    return found.filter(F.col(score) >= LEAST_QUALITY).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates: that of the smallest id.

    Rows of a component without any id, and rows with one id, are told apart by
    a digest of all their columns: the first by digest stays. A repeated row
    stays once.

    Only keys and fingerprints are grouped and joined; texts are read once more
    at the end, when the rows that go are taken out by their keys. Those are
    broadcast if their measured size allows. A repeated row has one key in all
    its copies, so such rows are read apart and folded.
    """
    on_workers(spark)
    key, fp = free_name(docs, "_key"), free_name(docs, "_fp")
    own = docs.withColumn(key, _row_key(docs))
    marked = own.withColumn(fp, simhash.fingerprints()).select("doc_id", F.col(key).alias("key"), F.col(fp).alias("fp"))
    keys = stored(marked.groupBy("doc_id", "key", "fp").agg(F.count("*").alias("copies")))
    components = simhash.components(keys.select("doc_id", "fp"))
    # Nulls come last, so an id wins over none.
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    rooted = stored(keys.select("fp", "key", "copies", place.alias("place")).join(components, "fp"))
    # One row for each component, apart from the aggregate, so that Spark can split the join at a large component.
    first = broadcast_if_small(rooted.groupBy("root").agg(F.min("place").alias("first")))
    decided = rooted.join(first, "root").select("key", "copies", (F.col("place") == F.col("first")).alias("stays"))
    gone = broadcast_if_small(decided.filter(~F.col("stays") | (F.col("copies") > 1)).select(F.col("key").alias(key), "stays"))
    single = own.join(gone.select(key), key, "left_anti")
    folded = gone.filter("stays").select(key)
    if folded.isEmpty():
        return single.select(docs.columns)
    repeated = own.join(folded, key, "left_semi").dropDuplicates([key])
    return single.unionByName(repeated).select(docs.columns)


def _row_key(docs: DataFrame):
    """Digest of all columns of a row: its text, and everything else as JSON, where null is no value."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull()))
    return F.unhex(F.sha2(F.concat_ws("\n", F.sha2(F.coalesce("text", F.lit("")), 256), rest), 256))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; see ``packing.pack_texts``."""
    on_workers(spark)
    return catalog.packed(docs)


STAGES = [
    ("language_id", by_language),
    ("quality", by_quality),
    ("near_dedup", without_near_duplicates),
    ("packing", into_sequences),
]

#: SQL cannot express the classifiers; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
