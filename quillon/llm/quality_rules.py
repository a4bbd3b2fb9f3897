"""Quality rules with thresholds that follow the corpus: quantile sketches per language and source, then a joined filter.

The sketch of a measure is the number of documents in each logarithmic bin of its integer value: values below 64 have a
bin each, larger ones keep their six leading bits, so a quantile is exact or low by 1/32 at most. Sketches merge by adding
counts - exactly, in any order - so the same table gives every (language, source), every language and the corpus. A
group of fewer than ``MIN_DOCS`` documents takes the thresholds of its language, a small language those of the corpus.

A document is kept if the base rules pass and each measure lies within its group's fences. The upper fence is the 90 %
quantile and ``REACH`` times its distance from the median more, the lower one the same below; ``GUARD`` is added so that a
group in which nearly all values are equal doesn't reject the next one. Symbols, repeated lines (but for one) and repeated words
have an upper fence; the mean length of words has both.

Scale: one scan of the texts makes a narrow table of measures; the sketch is a map-side combined count, so a hot source is
a few hundred rows per task; thresholds are as many as sources and join by (lang, source), for which Spark picks
broadcast by size or a sort-merge join that it can split. All in DataFrame functions; no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import SPACE_CLASS, Work, read_table, whole

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, REACH = 200, 3
#: Room beyond a fence, in the measures' units (thousandths).
GUARD = {"symbol": 50, "dup_line": 200, "repeat": 250, "word_len": 500}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared as strings; their hashes only tell
    which texts have no repeat at all."""
    at = lambda k: F.get(words, k)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))

    def covered(windows):
        same = lambda i, j: (F.get(windows, i)["a"] == F.get(windows, j)["a"]) & (F.get(windows, i)["b"] == F.get(windows, j)["b"]) & (F.get(windows, i)["c"] == F.get(windows, j)["c"])
        last = F.size(windows) - 1
        repeated = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: F.when((i > 0) & same(i, F.greatest(i - 1, F.lit(0))), True).otherwise((i < last) & same(i, F.least(i + 1, last))),
        )
        places = F.array_sort(F.transform(repeated, lambda i: F.get(windows, i)["i"]))
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    windows = F.sort_array(F.transform(starts, lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("i"))))
    any_twice = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 4, F.lit(0)).when(any_twice, _let(windows, covered)).otherwise(F.lit(0))


def with_measures(df: DataFrame, text: Column) -> DataFrame:
    """Adds the base counts and the four measures of a text that has no nulls."""
    words = F.array_remove(F.split(text, SPACE_CLASS + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, F.size(w)).cast("long").alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    df = df.withColumn("_c", counts)
    pick = {"n_words": "_c.w.n_words", "word_chars": "_c.word_chars", "n_symbols": "_c.n_symbols", "n_dup_lines": "_c.l.n_dup_lines", "n_repeat_words": "_c.w.n_repeat_words", "n_lines": "_c.l.n_lines"}
    df = df.select("*", *[F.col(v).alias(k) for k, v in pick.items()]).drop("_c")
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"1000 * {a} div {b}")).otherwise(F.lit(0)).cast("long")
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol": per("n_symbols", "n_words"),
            "dup_line": per("greatest(n_dup_lines - 1, 0)", "n_lines"),
            "repeat": per("n_repeat_words", "n_words"),
            "word_len": per("word_chars", "n_words"),
        }
    )


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): one mergeable sketch per language, source and measure."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in GUARD]))
    flat = measures.filter(~F.col("base_failed")).select("lang", "source", stack.alias("x")).select("lang", "source", "x.measure", "x.v")
    # CAST keeps six leading bits: the bin is named by its least value
    bin_of = F.expr("CASE WHEN v < 64 THEN v ELSE shiftleft(shiftright(v, length(bin(v)) - 6), length(bin(v)) - 6) END")
    return flat.groupBy("lang", "source", "measure", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _fences(bins: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Documents and fences of each group of ``keys``, from sketches merged over the other keys."""
    merged = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    by = ", ".join([*keys, "measure"])
    ranked = merged.withColumns({"upto": F.expr(f"sum(n) OVER (PARTITION BY {by} ORDER BY bin)"), "total": F.expr(f"sum(n) OVER (PARTITION BY {by})")})
    q = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bin")))
    quantiles = ranked.groupBy(*keys, "measure").agg(q(10).alias("q10"), q(50).alias("q50"), q(90).alias("q90"), F.max("total").alias("total"))
    guard = F.create_map(*[F.lit(x) for kv in GUARD.items() for x in kv])[F.col("measure")].cast("long")
    fenced = quantiles.withColumns(
        {
            "high": F.col("q90") + REACH * (F.col("q90") - F.col("q50")) + guard,
            "low": F.when(F.col("measure") == "word_len", F.col("q10") - REACH * (F.col("q50") - F.col("q10")) - guard).otherwise(F.lit(0)),
        }
    )
    pick = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    fences = [pick(c, m) for m in GUARD for c in ("low", "high")]
    wide = fenced.groupBy(*keys).agg(F.max("total").alias("total"), *fences)
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*[F.col(k).alias(f"{level}_{k}") for k in keys], F.struct(*names).alias(level))


def thresholds(bins: DataFrame) -> DataFrame:
    """(t_lang, t_source, t): each group's fences, from the finest level that has ``MIN_DOCS`` documents."""
    bins = bins.withColumn("all", F.lit(1))
    own, of_lang, of_all = _fences(bins, ["lang", "source"], "own"), _fences(bins, ["lang"], "of_lang"), _fences(bins, ["all"], "of_all")
    joined = own.join(of_lang, F.col("own_lang").eqNullSafe(F.col("of_lang_lang"))).withColumn("one", F.lit(1)).join(of_all, F.col("one") == F.col("of_all_all"))
    chosen = F.when(F.col("own.total") >= MIN_DOCS, F.col("own")).when(F.col("of_lang.total") >= MIN_DOCS, F.col("of_lang")).otherwise(F.col("of_all"))
    return joined.select(F.col("own_lang").alias("t_lang"), F.col("own_source").alias("t_source"), chosen.alias("t"))


def quality(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``df``: doc_id, the base counts, base_failed, kept, lang and source.

    A null text counts as empty and fails the base rules, as every text under ``MIN_WORDS`` words does. A null language
    or source is a group like any other; a null id is carried. Repeated rows each count in the sketches and get the same
    verdict; a value equal to a fence is inside. An empty table gives no rows. Columns not named here are ignored.
    """
    work = Work(spark, "quality")
    cols = {"doc_id": id_col, "lang": lang_col, "source": source_col, "text": text_col}
    base = df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()]).withColumn("text", whole(F.col("text")))
    measures, _ = work.table(with_measures(base, F.col("text")).drop("text"), "measures")
    bins, _ = work.table(sketches(measures), "sketches")
    judged = measures.join(thresholds(bins), F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for m in GUARD:
        inside = inside & F.col(m).between(F.col(f"t.low_{m}"), F.col(f"t.high_{m}"))
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "lang", "source")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, read_table(spark, sf_dir, "documents")).drop("lang", "source")


def _sql() -> str:
    fence = lambda c, keys: ", ".join(f"max({c}) FILTER (measure = '{m}') AS {c}_{m}" for m in GUARD)
    guard = "CASE measure " + " ".join(f"WHEN '{m}' THEN {g}" for m, g in GUARD.items()) + " END"

    def level(name: str, keys: str) -> str:
        k = keys + ", " if keys else ""
        return f"""
{name}_r AS (SELECT {k}measure, bin, n, sum(n) OVER (PARTITION BY {k}measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {k}measure) AS total
  FROM (SELECT {k}measure, bin, sum(n) AS n FROM bins GROUP BY ALL)),
{name}_q AS (SELECT {k}measure, min(bin) FILTER (100 * upto >= 10 * total) AS q10, min(bin) FILTER (100 * upto >= 50 * total) AS q50,
  min(bin) FILTER (100 * upto >= 90 * total) AS q90, max(total) AS total FROM {name}_r GROUP BY ALL),
{name}_f AS (SELECT {k}measure, total, q90 + {REACH} * (q90 - q50) + {guard} AS high,
  CASE WHEN measure = 'word_len' THEN q10 - {REACH} * (q50 - q10) - {guard} ELSE 0 END AS low FROM {name}_q),
{name} AS (SELECT {k}max(total) AS total, {fence("low", keys)}, {fence("high", keys)} FROM {name}_f {"GROUP BY " + keys if keys else ""}),"""

    pick = ", ".join(f"CASE WHEN o.total >= {MIN_DOCS} THEN o.{c}_{m} WHEN l.total >= {MIN_DOCS} THEN l.{c}_{m} ELSE a.{c}_{m} END AS {c}_{m}" for m in GUARD for c in ("low", "high"))
    inside = " AND ".join(f"m.{m} BETWEEN t.low_{m} AND t.high_{m}" for m in GUARD)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, a, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win WHERE c IS NOT NULL) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(s, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(s)::BIGINT - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d JOIN w USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol, CASE WHEN n_lines > 0 THEN 1000 * greatest(n_dup_lines - 1, 0) // n_lines ELSE 0 END AS dup_line,
  CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_len FROM base),
flat AS (SELECT lang, source, unnest([{", ".join(f"'{m}'" for m in GUARD)}]) AS measure, unnest([{", ".join(GUARD)}]) AS v FROM m WHERE NOT base_failed),
bins AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bin, count(*) AS n FROM flat GROUP BY ALL),
{level("o", "lang, source")}{level("l", "lang")}{level("a", "")}
t AS (SELECT o.lang, o.source, {pick} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, false) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""


OP4_SQL = _sql()
