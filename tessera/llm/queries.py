"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, language, line_dedup, lm, near_dup, packing, toxicity, url_filter, warc
from tessera.llm.common import crc_mod

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_packing(_read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.train(docs, crc_mod("doc_id", 4) != 2)
    found = language.predict(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page's outcome is that of the document that its url names by number; bad is low quality or toxic."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]+)", 1)
    named = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return named.join(labels.groupBy("doc_id").agg(F.max(bad).alias("bad")), "doc_id").select("page_id", "bad")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.judge(pages, RULES, page_outcomes(pages, _read(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).drop("longest")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    gone = line_dedup.removed_by_document(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    left = F.when(F.col("places").isNull(), F.col("text")).otherwise(line_dedup.without_lines(F.col("text"), F.col("places")))
    return docs.select("doc_id", text.alias("text")).join(gone, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.size("places").cast("long"), F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.array_join("places", ","), F.lit("")).alias("removed"),
        F.sha2(left.cast("binary"), 256).alias("text_sha256"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_lm_score": op5_lm_score,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language": op7_language,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
}

_RULES_SQL = ", ".join(f"('{r}', '{url_filter.split_rule(r)[0]}', '{url_filter.split_rule(r)[1]}', '{v}')" for r, v in RULES)

ORACLE = {
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
    """,
    "op8_url_filter": rf"""
        WITH rules(rule, r_host, r_path, verdict) AS (VALUES {_RULES_SQL}),
        u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
                 FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id),
        o AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
              FROM (SELECT page_id, TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) AS doc_id FROM u) JOIN labels USING (doc_id) GROUP BY page_id),
        h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM u LEFT JOIN o USING (page_id) GROUP BY host),
        hd AS (SELECT *, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM h),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY domain, suffix),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
        a AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS prior FROM s),
        sm AS (SELECT suffix, (bad + 10::DOUBLE * prior) / (n + 10::DOUBLE) AS mean FROM s, a),
        dm AS (SELECT domain, (bad + 10::DOUBLE * sm.mean) / (n + 10::DOUBLE) AS mean FROM d JOIN sm USING (suffix)),
        hm AS (SELECT host, (bad + 10::DOUBLE * dm.mean) / (n + 10::DOUBLE) AS mean, n + 10::DOUBLE AS weight FROM hd JOIN dm USING (domain))
        SELECT u.page_id, u.host, u.path, best.rule,
               coalesce(best.verdict, CASE WHEN mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
               round(mean, 6) AS bad_share
        FROM u JOIN hm USING (host) LEFT JOIN best USING (page_id)
    """,
    "op10_line_dedup": r"""
        WITH every AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        bare AS (SELECT doc_id, i, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM every),
        lines AS (SELECT doc_id, i, x, len(string_split_regex(x, '[\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM bare WHERE x <> ''),
        next AS (SELECT *, lead(x) OVER d AS x1, lead(n) OVER d AS n1, lead(x, 2) OVER d AS x2 FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
        runs AS (SELECT doc_id, p, 1 AS size, x AS k FROM next WHERE n >= 50
                 UNION ALL SELECT doc_id, p, 2, x || chr(10) || x1 FROM next WHERE n + n1 >= 50
                 UNION ALL SELECT doc_id, p, 3, x || chr(10) || x1 || chr(10) || x2 FROM next WHERE x2 IS NOT NULL),
        again AS (SELECT doc_id, p, size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM runs) WHERE nth > 1),
        gone AS (SELECT DISTINCT l.doc_id, l.i FROM again a JOIN lines l ON l.doc_id = a.doc_id AND l.p BETWEEN a.p AND a.p + a.size - 1),
        left_over AS (SELECT e.doc_id, count(g.i) AS n_removed, coalesce(string_agg(g.i::VARCHAR, ',' ORDER BY e.i), '') AS removed,
                             sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN e.raw END, chr(10) ORDER BY e.i), '')) AS text_sha256
                      FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
        SELECT doc_id, n_removed, removed, text_sha256 FROM left_over
    """,
}
