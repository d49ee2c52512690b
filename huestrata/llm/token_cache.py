"""Token counts kept by content digest and tokenizer digest; only texts not met before are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huestrata.llm.common import free_name
from huestrata.llm.wordwise import encoder

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it: the version of a tokenizer."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + file.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """Stored counts; none if the folder does not exist yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(
    docs: DataFrame,
    cache: str,
    tokenizer: str,
    *,
    text: str = "text",
    n_tokens: str = "n_tokens",
) -> DataFrame:
    """``docs`` with the token count of every whole text, by way of the cache in folder ``cache``.

    Content is normalised as far as the count cannot change: null is the empty
    text, and a text is its UTF-8 bytes. Digests missing from the cache are
    encoded, one text for each, and appended; then every row takes its count
    from the cache. Copies are folded before the shuffle, so a hot text is
    encoded once and costs one row for each task. Two runs that append the same
    digest at once leave two equal rows, which are read as one. An existing
    column ``n_tokens`` is replaced; rows keep their number, repeats included.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    _encode_misses(docs.select(digest.alias("content_digest"), content.alias("text")), cache, tokenizer, version)
    rows = docs.drop(n_tokens)
    own, count = free_name(docs, "_digest"), free_name(docs, "_count")
    counts = _known(spark, cache, version).select(
        F.col("content_digest").alias(own), F.col("n_tokens").alias(count)
    )
    keyed = docs.withColumn(own, digest).select(*rows.columns, own)
    return keyed.join(counts, own, "left").withColumnRenamed(count, n_tokens).drop(own)


def _known(spark: SparkSession, cache: str, version: str) -> DataFrame:
    own = read_cache(spark, cache).filter(F.col("tokenizer_digest") == version)
    return own.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode_misses(texts: DataFrame, cache: str, tokenizer: str, version: str) -> None:
    known = _known(texts.sparkSession, cache, version).select("content_digest")
    # Any row of a digest will do: equal digests are equal texts.
    misses = texts.dropDuplicates(["content_digest"]).join(known, "content_digest", "left_anti")
    count = counter(tokenizer)
    misses.select(
        "content_digest", F.lit(version).alias("tokenizer_digest"), count("text").alias("n_tokens")
    ).write.mode("append").parquet(cache)


def counter(tokenizer: str):
    """Arrow function from texts to token counts, special strings read as the library does by default."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with encoder(tokenizer) as own:
            for texts in batches:
                yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return count
