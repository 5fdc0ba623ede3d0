"""Text operators (I) and locale strings (C4, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.fixtures import derive, duck
from assetflow.functions import display as D
from assetflow.functions import text as X
from assetflow.operators import lookups, sets
from assetflow.operators.detections import best_recognition as best_of
from assetflow.plans.outcomes import summarize_batch
from assetflow.queries.base import query, rounded
from assetflow.queries.catalog import DURATION_SQL, SIZE_SQL

# A user-supplied character table; here a few pairs, enough to show both directions.
TRADITIONAL, SIMPLIFIED = "漢國", "汉国"
BLANK = r"\t\x0B\f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(duck("texts", rf"""
SELECT text_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[{BLANK}]+(\n|\z)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A[{BLANK}\n]+|[{BLANK}\n]+\z', '', 'g') AS text
FROM (SELECT text_id, replace(text, '. ', '.   ' || chr(13) || chr(10) || ' ' || chr(10) || chr(10)) || '  ' AS text FROM texts)"""))
def normalize_text(spark, sf):
    texts = derive(spark, sf, "texts").withColumn(
        "text", F.concat(F.replace("text", F.lit(". "), F.lit(".   \r\n \n\n")), F.lit("  "))
    )
    return texts.select("text_id", X.normalize_text("text").alias("text"))


@query(duck("texts", f"""
SELECT text_id, CASE WHEN confidence >= 0.5 THEN translate(text, '{TRADITIONAL}', '{SIMPLIFIED}') ELSE text END AS text FROM texts"""))
def map_characters(spark, sf):
    texts = derive(spark, sf, "texts").withColumn("language", F.when(F.col("confidence") >= 0.5, "zh").otherwise("other"))
    table = spark.createDataFrame(list(zip(TRADITIONAL, SIMPLIFIED, strict=True)), "source string, target string")
    return X.map_characters_for(texts, table, "language", "zh").select("text_id", "text")


def _count_sql(ranges: str) -> str:
    return f"length(regexp_replace(text, '[^{ranges}]', '', 'g'))"


STATS_SQL = (
    r", stats AS (SELECT text_id, confidence, length(regexp_replace(text, '[\p{Z}\p{Cc}]', '', 'g')) AS visible, "
    + ", ".join(f"{_count_sql(ranges)} AS {name}" for name, ranges in X.SCRIPTS.items())
    + f", least({_count_sql(TRADITIONAL)}, {_count_sql(SIMPLIFIED)}) AS mixed FROM texts)\n"
)


@query(duck("texts", STATS_SQL + "SELECT * EXCLUDE (confidence) FROM stats"))
def script_stats(spark, sf):
    return X.with_script_stats(derive(spark, sf, "texts"), "text", TRADITIONAL, SIMPLIFIED).drop("text", "confidence")


SCORES_SQL = STATS_SQL + """
, scored AS (SELECT text_id, confidence, CASE WHEN visible > 0 THEN base + s ELSE CAST('-inf' AS DOUBLE) END AS score, p AS profile, o AS profile_ord FROM (
  SELECT text_id, confidence, visible, 100 * confidence + least(12.0::DOUBLE, 0.35::DOUBLE * visible) AS base, unnest(['chinese','english','latin','korean','cyrillic','arabic','thai']) AS p, unnest(range(0, 7)) AS o, unnest([
    CASE WHEN kana > 0 THEN 22 + 0.8::DOUBLE * kana ELSE 0 END + CASE WHEN han > 0 THEN 18 + 0.35::DOUBLE * han - 1.5::DOUBLE * mixed ELSE 0 END + CASE WHEN kana = 0 AND han = 0 AND latin > 0 THEN 6 + 0.12::DOUBLE * latin ELSE 0 END - 1.6::DOUBLE * hangul - 1.2::DOUBLE * cyrillic - 1.2::DOUBLE * arabic,
    CASE WHEN latin > 0 THEN 18 + 0.3::DOUBLE * latin ELSE -28 END - (han + kana + 1.5::DOUBLE * hangul + 1.4::DOUBLE * cyrillic + 1.4::DOUBLE * arabic) - 0.35::DOUBLE * diacritic - CASE WHEN latin BETWEEN 1 AND 3 THEN 6 ELSE 0 END,
    CASE WHEN latin > 0 THEN 18 + 0.32::DOUBLE * latin ELSE -28 END + CASE WHEN diacritic > 0 THEN 6 + 0.5::DOUBLE * diacritic ELSE 0 END - (han + kana + 1.5::DOUBLE * hangul + 1.25::DOUBLE * cyrillic + 1.25::DOUBLE * arabic),
    CASE WHEN hangul > 0 THEN 24 + 0.9::DOUBLE * hangul ELSE -30 END - 0.5::DOUBLE * han - 1.5::DOUBLE * kana - 1.2::DOUBLE * cyrillic - 1.2::DOUBLE * arabic,
    CASE WHEN cyrillic > 0 THEN 30 + 1.05::DOUBLE * cyrillic ELSE -30 END - (han + kana + 1.5::DOUBLE * hangul + 1.25::DOUBLE * arabic),
    CASE WHEN arabic > 0 THEN 34 + 1.15::DOUBLE * arabic ELSE -30 END - (han + kana + 1.5::DOUBLE * hangul + 1.25::DOUBLE * cyrillic),
    CASE WHEN thai > 0 THEN 32 + 1.05::DOUBLE * thai ELSE -30 END - (han + kana + 1.5::DOUBLE * hangul + 1.25::DOUBLE * cyrillic + 1.25::DOUBLE * arabic) - 0.18::DOUBLE * latin]) AS s
  FROM stats))
"""


def _scores(spark, sf):
    counted = X.with_script_stats(derive(spark, sf, "texts"), "text", TRADITIONAL, SIMPLIFIED).drop("text")
    cells = F.array(*[
        F.struct(F.lit(p).alias("profile"), F.lit(n).alias("profile_ord"), s.alias("score"))
        for n, (p, s) in enumerate(X.script_scores().items())
    ])
    return counted.select("text_id", "confidence", F.explode(cells).alias("s")).select("text_id", "confidence", "s.*")


@query(duck("texts", SCORES_SQL + "SELECT text_id, profile, round(score, 6) AS score FROM scored"))
def script_score(spark, sf):
    return _scores(spark, sf).select("text_id", "profile", rounded("score").alias("score"))


@query(duck("texts", SCORES_SQL + """
SELECT text_id, profile, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY round(score, 6) DESC, confidence DESC, profile_ord) = 1"""))
def best_recognition(spark, sf):
    return best_of(_scores(spark, sf).withColumn("score", rounded("score")), "text_id").select("text_id", "profile", "score")


NORMAL_URL = r"""CASE WHEN h <> '' THEN CASE WHEN t LIKE '/%' THEN lower(h) || t ELSE lower(h) || '/' || t END END"""


@query(duck("url_texts", rf"""
SELECT page_id, position, url FROM (SELECT page_id, position, {NORMAL_URL} AS url FROM (
  SELECT page_id, position, regexp_extract(u, '^(?i:https?)://[^/?#]+', 0) AS h, substr(u, length(regexp_extract(u, '^(?i:https?)://[^/?#]+', 0)) + 1) AS t FROM (
    SELECT page_id, o AS position, regexp_replace(m, '[.,;:!?)\]}}]+$', '') AS u FROM (
      SELECT page_id, unnest(ms) AS m, unnest(range(0, len(ms))) AS o FROM (SELECT page_id, regexp_extract_all(text, '(?i)https?://[^\s"''<>]+') AS ms FROM url_texts)))))
WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY position) = 1"""))
def extract_urls(spark, sf):
    return X.extract_urls(derive(spark, sf, "url_texts"), "page_id")


@query(duck("url_texts", r"""
SELECT page_id, a, regexp_matches(a, '^(?i:https?)://[^/?#]+') AND NOT regexp_matches(a, '[ \t\r\n]') AS a_single, regexp_matches(b, '^(?i:https?)://[^/?#]+') AND NOT regexp_matches(b, '[ \t\r\n]') AS b_single
FROM (SELECT page_id, trim('  ' || url || ' ') AS a, trim(text) AS b FROM url_texts)"""))
def is_single_url(spark, sf):
    rows = derive(spark, sf, "url_texts").withColumn("a", F.concat(F.lit("  "), "url", F.lit(" ")))
    return rows.select(
        "page_id", F.trim("a").alias("a"), X.is_single_url(F.col("a")).alias("a_single"), X.is_single_url(F.col("text")).alias("b_single")
    )


@query(duck("locales", """
SELECT k.key, coalesce(a.v, b.v, k.key) AS text FROM (SELECT DISTINCT key FROM locales UNION SELECT key || '_extra' FROM locales) k
LEFT JOIN (SELECT key, min(value) AS v FROM locales WHERE locale = 'assistant' GROUP BY 1) a ON a.key = k.key
LEFT JOIN (SELECT key, min(value) AS v FROM locales WHERE locale = 'user' GROUP BY 1) b ON b.key = k.key"""))
def translate(spark, sf):
    strings = derive(spark, sf, "locales")
    keys = strings.select(F.explode(F.array("key", F.concat("key", F.lit("_extra")))).alias("key")).distinct()
    return lookups.translate(keys, strings, "assistant", "user")


@query(duck("locales", """
, v AS (SELECT locale, key, min(value) AS value FROM locales GROUP BY 1, 2), b AS (SELECT key, value FROM v WHERE locale = 'user')
SELECT v.locale, (SELECT count(*) FROM b) - count(b.key) AS missing_keys, count(*) - count(b.key) AS extra_keys, count_if(coalesce(b.value = v.value, FALSE)) AS same_as_base
FROM v LEFT JOIN b ON v.key = b.key GROUP BY v.locale"""))
def locale_coverage(spark, sf):
    return sets.locale_coverage(derive(spark, sf, "locales"), "user")


@query(duck("work runs", f"""
, s AS (SELECT r.run_id, any_value(trigger_source) AS src, any_value(output_format) AS fmt, any_value(was_canceled) AS c, any_value(original_bytes) AS b, count(w.run_id) AS n, count_if(coalesce(failed, FALSE)) AS f FROM runs r LEFT JOIN work w ON w.run_id = r.run_id GROUP BY 1)
SELECT run_id, CASE WHEN src = 'manual' THEN 'Manual' ELSE 'Watch' END || ' · ' || upper(fmt) || CASE WHEN c THEN ' · Processed ' || n || '/' || n || ' before cancellation'
    ELSE ' · Total ' || n || ' · Success ' || (n - f) || ' · Failed ' || f END AS summary_line,
  'Input ' || {SIZE_SQL.format('b')} || ' · Estimate ' || {SIZE_SQL.format('lo')} || ' - ' || {SIZE_SQL.format('hi')} || ' · Duration ' || {DURATION_SQL} AS detail_line
FROM (SELECT *, b // 3 AS lo, b // 2 AS hi, b * 37 % 9000000 AS ms FROM s)"""))
def history_lines(spark, sf):
    runs = summarize_batch(derive(spark, sf, "work"), derive(spark, sf, "runs")).withColumns({
        "estimated_min": F.expr("original_bytes div 3"), "estimated_max": F.expr("original_bytes div 2"),
        "duration_ms": F.col("original_bytes") * 37 % 9000000,
    })
    return runs.select(
        "run_id", D.history_summary_line().alias("summary_line"), D.history_detail_line().alias("detail_line")
    )
