"""Boilerplate lines by their spread over distinct sites.

A line's spread is the number of distinct sites it stands on. One aggregation makes a HyperLogLog sketch of sites per line
hash straight from the lines, merged as Spark merges partial aggregates, so a line that a third of all documents share
reaches its reducer as one sketch per map task. Lines that are clearly above or below the threshold are decided by the estimate;
only lines within ``MARGIN`` standard errors of it get an exact count of their distinct sites. Lines of wide spread are then
removed from every document on every site. The threshold is the square root of the number of sites, ``LEAST_SITES`` at least.

The lines' hashes and places are written once and read by every step. A line whose sites have the same smallest and greatest
name is on one site, and takes its sketch no further than its aggregation. Which lines go is a small table of hashes; only
lines that go travel back to their documents, by a join that Spark broadcasts when they are few by size, else merges and splits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import SPACE_CLASS, Work, read_table, whole

#: Sites a line may stand on at least, however few sites there are; words a line needs to be judged at all.
LEAST_SITES, MIN_WORDS = 3, 1
#: Sketch size (log2 of registers), its relative standard error, and standard errors within which counts are made exact.
LG_K, ERROR, MARGIN = 8, 0.065, 4.0


def line_key(line):
    """Two hashes of a line with its white space made single and trimmed, lower-cased."""
    clean = F.lower(F.trim(F.regexp_replace(line, SPACE_CLASS + "+", " ")))
    return F.struct(F.xxhash64(clean).alias("a"), F.xxhash64(F.lit(1), clean).alias("b"))


def spread(lines: DataFrame, work: Work, max_sites: int) -> DataFrame:
    """(a, b, n_sites, exact) of the lines on more than ``max_sites`` sites; ``lines`` has a, b and site."""
    low, high = max_sites * (1 - MARGIN * ERROR), (max_sites + 1) * (1 + MARGIN * ERROR)
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("site").alias("s0"), F.max("site").alias("s1"))
    estimates, _ = work.table(sketched.filter("s0 <> s1").select("a", "b", F.hll_sketch_estimate("sketch").alias("estimate")), "estimates")
    wide = estimates.filter(F.col("estimate") > high).select("a", "b", F.col("estimate").alias("n_sites"), F.lit(False).alias("exact"))
    near = estimates.filter((F.col("estimate") >= low) & (F.col("estimate") <= high)).select(F.col("a").alias("n_a"), F.col("b").alias("n_b"))
    pairs = lines.select("a", "b", "site").join(near, (F.col("a") == F.col("n_a")) & (F.col("b") == F.col("n_b"))).select("a", "b", "site").distinct()
    exact = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_sites")).filter(F.col("n_sites") > max_sites)
    return wide.unionByName(exact.select("a", "b", "n_sites", F.lit(True).alias("exact")))


def threshold(docs: DataFrame) -> int:
    """Sites a line may stand on: the square root of the number of sites, rounded down."""
    return max(LEAST_SITES, math.isqrt(docs.select("site").distinct().count()))


def remove_lines(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", max_sites: int | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, text without boilerplate lines, n_lines, n_removed, text_sha256.

    Lines are parted by \n; lines under ``min_words`` words are never judged, so blank lines stay. A null text is empty (one
    empty line); a null site is a site of its own. Lines that stand on exactly ``max_sites`` sites stay. Rows with a null id
    take part; repeated rows get the same text. An empty table gives no rows. Other columns are ignored.
    """
    work, cols = Work(spark, "lines"), {"doc_id": id_col, "text": text_col, "site": site_col}
    docs = df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])
    docs = docs.select("doc_id", whole(F.col("text")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col("site").cast("string")), F.lit("")).alias("site"))
    max_sites = threshold(docs) if max_sites is None else max_sites
    words = F.size(F.array_remove(F.split(F.col("line"), SPACE_CLASS + "+"), "")) if min_words > 1 else F.col("line").rlike(f"[^{SPACE_CLASS[1:-1]}]").cast("int")
    placed = docs.select("doc_id", F.xxhash64("text").alias("h"), "site", F.posexplode(F.split("text", "\n")).alias("place", "line")).filter(words >= min_words)
    lines, lines_path = work.table(placed.select("doc_id", "h", "site", "place", line_key(F.col("line")).alias("k")).select("doc_id", "h", "site", "place", "k.a", "k.b"), "lines")
    bad, _ = work.table(spread(lines, work, max_sites), "spread")
    # a document's lines that go, by place: only these rows return to it
    hits = lines.select("doc_id", "h", "place", "a", "b").join(bad.select(F.col("a").alias("x_a"), F.col("b").alias("x_b")), (F.col("a") == F.col("x_a")) & (F.col("b") == F.col("x_b")))
    gone = hits.groupBy(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h")).agg(F.collect_set("place").alias("gone"))
    gone, _ = work.table(gone, "gone")
    work.drop(lines_path)
    joined = docs.withColumn("h", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
    parts, cut = F.split("text", "\n"), F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.when(F.size(cut) == 0, F.col("text")).otherwise(F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(cut, i)), "\n"))
    out = joined.select("doc_id", kept.alias("text"), F.size(parts).cast("long").alias("n_lines"), F.size(cut).cast("long").alias("n_removed"))
    return out.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_lines(spark, read_table(spark, sf_dir, "documents")).drop("text")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS s FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS i FROM d),
k AS (SELECT doc_id, source, i, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS key,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} AS judged FROM l),
w AS (SELECT key FROM k WHERE judged GROUP BY key HAVING count(DISTINCT coalesce('=' || source, '')) > (SELECT greatest({LEAST_SITES}, floor(sqrt(count(DISTINCT coalesce('=' || source, ''))))) FROM d)),
m AS (SELECT k.*, judged AND w.key IS NOT NULL AS gone FROM k LEFT JOIN w ON k.key = w.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
