"""URL filters by a Bloom filter cascade, in DataFrame expressions only.

A rule is ``host/path``: it fits its host and all subdomains, for paths that start with its path.  Candidate keys of
a URL are its host suffixes joined with path prefixes, of the shapes that rules have.  The corpus's distinct candidate
keys are the key universe.  Level 1 of a cascade holds the listed keys; level 2 holds the keys of the universe that
level 1 lets through by mistake; level 3 the listed keys that level 2 catches by mistake, and so on until a level makes
no mistake.  Membership of any key of the universe is then exact, and judging a URL needs no join: the bits
are read from one constant.  One cascade holds the block rules, one the allow rules.

The first level's error rate is that of the listed keys to the universe, so all levels together take about
``1.44 * log2(universe / listed)`` bits a key listed, whatever the corpus; ``max_bits`` bounds it and a longer
list is refused.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; with no rule the
verdict is ``default`` ("allow": the key is on no list); rules repeated count once, a rule both allowed and blocked
blocks; of fitting rules the one of most characters wins, then the one with the longer host; empty tables give no
rows; columns that clash with the results are replaced, others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import written
from assetflow.session import table

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lowered, and path of a URL as the rules see them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWERED), path


def candidate_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """array<string>: the keys of a URL that have the shape (labels of the host, characters of the path) of a rule."""
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for r in rules})
    keys = [F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)) for labels, chars in shapes]
    return F.array_distinct(F.array(*keys)) if keys else F.expr("cast(array() as array<string>)")


def _hits(words: Column, level: int, bits: int, hashes: int, key: Column) -> Column:
    """Whether all bits of a key are set."""
    found = F.lit(True)
    for p in _positions(level, bits, hashes, key):
        found = found & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
    return found


def _positions(level: int, bits: int, hashes: int, key: Column) -> list[Column]:
    """Every level hashes anew: keys that collide in one level need not in the next."""
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _filter_words(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row ``words``: the bits of a Bloom filter of ``keys`` (key) as array<bigint>."""
    at = keys.select(F.explode(F.array(*_positions(level, bits, hashes, F.col("key")))).alias("p"))
    some = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("v"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("v"))
    full = some.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words"))


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both: distinct, one column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, universe_size: int, max_bits: int = 1 << 27):
        self.levels: list[tuple[DataFrame, int, int]] = []
        inside, outside = listed, universe
        while n := inside.count():
            rate = min(0.5, n / (max(universe_size, 1) * math.sqrt(2))) if not self.levels else 0.5
            hashes = max(1, round(-math.log2(rate)))
            bits = -(-math.ceil(1.4427 * n * hashes) // 64) * 64
            if bits > max_bits:
                raise ValueError(f"{n} listed keys need {bits} bits; max_bits is {max_bits}")
            words = written(_filter_words(inside, len(self.levels), bits, hashes), "bloom")
            self.levels.append((words, bits, hashes))
            passed = self._level(outside.select("key"), len(self.levels) - 1)
            if len(self.levels) == 1:  # what is let through is few: take the listed keys themselves out of it
                both = passed.select("key", F.lit(0).alias("l")).unionByName(listed.select("key", F.lit(1).alias("l")))
                passed = both.groupBy("key").agg(F.max("l").alias("l")).filter("l = 0").select("key")
            inside, outside = written(passed, "mistakes"), inside

    def _level(self, keys: DataFrame, k: int) -> DataFrame:
        words, bits, hashes = self.levels[k]
        return keys.withColumn("_words", words.scalar()).filter(_hits(F.col("_words"), k, bits, hashes, F.col("key"))).drop("_words")

    def columns(self, name: str) -> dict[str, Column]:
        """The filters as columns to add before :meth:`contains` is used."""
        return {f"{name}{k}": words.scalar() for k, (words, _, _) in enumerate(self.levels)}

    def contains(self, key: Column, name: str) -> Column:
        """Listed if the first level that lacks the key is a level of mistakes, or if no level lacks it and their number is odd."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            _, bits, hashes = self.levels[k]
            verdict = F.when(_hits(F.col(f"{name}{k}"), k, bits, hashes, key), verdict).otherwise(F.lit(k % 2 == 1))
        return verdict


def _fitting(cascade: Cascade, name: str) -> Column:
    """The candidate keys listed in a cascade, ready for comparing."""
    fits = F.filter("_keys", lambda k: cascade.contains(k, f"_{name}"))
    entry = lambda k: F.struct(F.length(k).alias("size"), F.instr(k, "/").alias("host"), k.alias("rule"), F.lit(name).alias("verdict"))
    return F.transform(fits, entry)


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict."""
    spark = df.sparkSession
    host, path = url_parts(F.col(url))
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict", "_keys")]
    keys = candidate_keys(F.col("host"), F.col("path"), [r for r, _ in rules])
    parts = df.select(*kept, host.alias("host"), path.alias("path")).withColumn("_keys", keys)
    universe = parts.select(F.explode("_keys").alias("key")).distinct()
    size = universe.agg(F.approx_count_distinct("key")).first()[0] if rules else 0
    blocked = {r for r, v in rules if v == "block"}
    lists = {"block": sorted(blocked), "allow": sorted({r for r, v in rules if v != "block"} - blocked)}
    cascades = {
        name: Cascade(spark.createDataFrame([(r,) for r in names], "key string"), universe, size) for name, names in lists.items() if names
    }
    for name, cascade in cascades.items():
        parts = parts.withColumns(cascade.columns(f"_{name}"))
    marked = [_fitting(cascade, name) for name, cascade in cascades.items()]
    if not marked:
        return parts.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    best = F.array_max(F.concat(*marked))
    judged = parts.select(*kept, "host", "path", best.alias("_best"))
    return judged.select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )


@llm_query(
    "op8_url_filter",
    r"""
    WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    rules(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (page_id)
    """,
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the five rules."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")
