"""Registered queries of this subpackage, and check SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huestrata.llm import (
    ann,
    bpe,
    language,
    maxscore,
    packing,
    quality,
    runs,
    simhash,
    threshold,
    token_cache,
    toxicity,
    warc,
    word_table,
)
from huestrata.llm.common import held_out, on_workers, table
from huestrata.sources.shared import shared_folder

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: A document is toxic from this probability on, and too long from this token count on.
TOXIC_FROM, TOKEN_LIMIT = 0.3, 512

#: A document is of good quality from this score on.
GOOD_FROM = 0.5


def _learning(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out())


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ChainModel:
    """A chain of the two label columns: low quality first, then toxic, fed with the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return toxicity.train(_learning(docs), labels, ["junk", "toxic"])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_chain(docs, model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "p_junk",
        "p_toxic",
        F.col("p_toxic").alias("score"),
        (F.col("p_toxic") >= TOXIC_FROM).alias("toxic"),
    )


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", maxscore.whole(F.col("embedding")).alias("vector"))
    return maxscore.top_k(rows.filter("vec_id % 50 = 0"), rows, 5)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index = ann.build(rows, members=11)
    return ann.search(index, rows.filter("vec_id % 100 = 0"), 10)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out())
    return quality.train(_learning(docs), labels)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    )


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return resolved.select(
        "record_id",
        "canonical_url",
        "resolved_id",
        "outcome",
        F.array_join(lines, "\n").alias("headers"),
        F.md5("body").alias("body_md5"),
        F.octet_length("body").cast("bigint").alias("n_bytes"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack_texts(docs, WORD_TOKENIZER, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fresh cache for each call: every text is encoded within the query.
    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    # The length is taken here, so that no text is carried through the join with the counts.
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes.alias("n_bytes"))
    counted = token_cache.count_tokens(docs, cache, BYTE_TOKENIZER)
    return counted.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def language_model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.train(_learning(docs))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the texts, by a hash of the id, repeat a stretch of their words from some place on.

    A null id plants nothing.
    """
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", hashed.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    at = chosen.withColumns({"n": n, "a": F.when(n > 0, g % n).cast("int"), "g": g})
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    joined = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return at.withColumn("p", period).select("doc_id", F.when(F.col("n") > 0, joined).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ranked = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("small")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.array_max(ranked)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.small")).alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return word_table.encode(docs, WORD_TOKENIZER).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Centroids, rounds and seed of the clustering; components are whole 1024ths.
CLUSTERS, ROUNDS, SEED, SIZE, SCALE = 8, 10, 3, 64, 1024


def op13_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", threshold.whole(F.col("embedding"), SCALE, SIZE).alias("vector"))
    found = threshold.cluster(rows, k=CLUSTERS, rounds=ROUNDS, seed=SEED)
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256")
    )


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return build(spark, sf_dir)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _query(f)
    for f in (
        op1_toxicity, op2_maxscore, op3_nn_descent, op4_byte_bpe, op5_simhash, op6_quality,
        op7_warc_revisits, op8_packing, op9_token_counts, op10_language, op11_runs, op12_word_bpe, op13_threshold,
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op2_maxscore"] = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(
           [CAST(x AS DOUBLE) for x in q.c], [CAST(x AS DOUBLE) for x in r.c]) AS BIGINT) AS score
  FROM v q JOIN v r ON r.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM o WHERE n <= 5
"""

ORACLE["op7_warc_revisits"] = r"""
WITH plain AS (
  SELECT page_id, html, length(url) % 4 AS kind, 1700000000 + page_id * 60 AS base,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages
), parts AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort([p for p in string_split(regexp_extract(u, '\?(.*)$', 1), '&') if p <> ''
      AND NOT starts_with(lower(regexp_extract(p, '^([^=]*)', 1)), 'utm_')
      AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ('fbclid', 'gclid', 'sessionid', 'sid', 'phpsessid', 'jsessionid')]), '&') AS params
  FROM plain
), c AS (
  SELECT *, host || path || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS canonical_url,
    '"' || md5(html) || '"' AS tag,
    strftime(make_timestamp((base - 86400) * 1000000), '%Y-%m-%d %H:%M:%S') || ' GMT' AS modified
  FROM parts
), revisit AS (
  SELECT page_id * 4 + 1 AS record_id, canonical_url, base - 30 AS taken, kind, tag, modified FROM c
  UNION ALL
  SELECT page_id * 4 + 2, canonical_url, base + 7200, kind, tag, modified FROM c
), asked AS (
  SELECT *, CASE kind WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 3 THEN '"0"' END AS own_tag,
    CASE WHEN kind = 2 THEN modified END AS own_date
  FROM revisit
), found AS (
  SELECT a.record_id, a.canonical_url, a.taken, a.own_tag, a.own_date, r.page_id, r.html, r.tag, r.modified,
    row_number() OVER (PARTITION BY a.record_id ORDER BY r.base DESC NULLS LAST, r.page_id DESC) AS n
  FROM asked a LEFT JOIN c r ON r.canonical_url = a.canonical_url AND r.base < a.taken AND r.html IS NOT NULL
), checked AS (
  SELECT *, coalesce(regexp_replace(own_tag, '^W/', '') = tag, own_date = modified) AS same FROM found WHERE n = 1
), said AS (
  SELECT *, CASE WHEN page_id IS NULL THEN 'no_response' WHEN same IS NULL THEN 'no_validator'
    WHEN same THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM checked
)
SELECT CAST(record_id AS BIGINT) AS record_id, canonical_url, CAST(page_id * 4 AS BIGINT) AS resolved_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || strlen(html) || chr(10)
    || 'content-type: text/html; charset=utf-8' || chr(10)
    || 'date: ' || strftime(make_timestamp(taken * 1000000), '%Y-%m-%d %H:%M:%S') || ' GMT' || chr(10)
    || 'etag: ' || coalesce(own_tag, tag) || chr(10) || 'last-modified: ' || modified || chr(10) || 'server: archive' END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5,
  CASE WHEN outcome = 'resolved' THEN CAST(strlen(html) AS BIGINT) END AS n_bytes
FROM said
"""


def _cluster_sql() -> str:
    """Lloyd's rounds one after the other, vectors and centroids as rows of (id, dimension, value)."""
    ctes = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"v AS MATERIALIZED (SELECT row, unnest(range({SIZE})) AS dim, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (
  SELECT k, unnest(range({SIZE})) AS dim, unnest(v) AS c
  FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM kept) WHERE k < {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT row, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM v JOIN c{i} USING (dim) GROUP BY row, k) GROUP BY row)""")
        if i < ROUNDS:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, dim, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT k, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS c FROM (
      SELECT k, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{i} USING (row) GROUP BY k, dim)) m USING (k, dim))""")
    return (
        "WITH " + ",\n".join(ctes) + f""",
named AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (row) JOIN named USING (k)"""
    )


ORACLE["op13_threshold"] = _cluster_sql()
