"""Exact duplicates by distributed most-significant-digit radix partitioning.

Every document is read as the byte string ``length, normalised text``. A round deals the documents that are still
together by their next digit - a block of successive bytes - and keeps a group on only while it holds several rows and
has bytes left. Groups are told apart by the bytes alone; no digest takes part in the comparison. Blocks widen by
``GROWTH`` a round, so a text of n bytes needs log(n) rounds, and each byte of a document is dealt at most once. A group has
a number of its own, given when its table is written, so groups whose rows share an id stay apart.

Scale: counting a round's groups is a map-side combined aggregation, so a group with a third of all rows reaches its
reducer as one row per map task. The groups with several rows are written as a table first; the join that takes the
documents to their next group then has two plain exchanges, which adaptive execution splits when a key is hot. The
driver sees one row count per round. Each round is a Parquet table in the shared folder, which outlives executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import SPACE_CLASS, Work, read_table, whole

#: Bytes of the first block, and how much wider each next block is.
FIRST_BLOCK, GROWTH = 32, 8


def normalise(text):
    return F.regexp_replace(whole(text), SPACE_CLASS + "+", " ")


def exact_groups(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, n_rounds.

    Texts are equal when identical after each run of white space is made one space; a null text equals the empty one.
    ``keep_id`` is the smallest id of the equal texts. Rows with a null id take part; they are kept only where no row
    of their group has an id (keep_id is then null). Rows that repeat both id and text cannot be told apart and are
    flagged alike; group_size counts each. Rows that share an id but not the text are in a group each. An empty table gives no rows. Other columns of ``df`` are ignored, whatever
    their names.
    """
    work = Work(spark, "radix")
    text = normalise(F.col(f"`{text_col}`"))
    raw = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    state = raw.select(
        "doc_id",
        F.octet_length("t").cast("long").alias("n"),
        F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
        F.lit(0).cast("long").alias("gid"),
        F.col("t").cast("binary").alias("rest"),
    )
    done, consumed, width, rounds, path = [], 0, FIRST_BLOCK, 0, None
    keys = ["n", "gid", "block"]
    while True:
        rounds += 1
        dealt = state.withColumn("block", F.expr(f"substring(rest, 1, {width})"))
        found = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least")).filter("size > 1")
        # a group's number holds once its table is written
        groups, groups_path = work.table(found.withColumn("number", F.monotonically_increasing_id()), "groups")
        g = groups.select(*[F.col(k).alias(f"g_{k}") for k in keys], "size", "least", "number")
        consumed += width
        same = (F.col("n") == F.col("g_n")) & (F.col("gid") == F.col("g_gid")) & (F.col("block") == F.col("g_block"))
        # the same plan at every size: texts move once a round, by their next block
        joined = dealt.join(g.hint("merge"), same, "left")
        alone = F.col("size").isNull()
        ended = alone | (F.col("n") <= F.lit(consumed))
        step = joined.select(
            "doc_id",
            "n",
            "text_sha256",
            F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"),
            F.col("number").alias("gid"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.lit(rounds).alias("n_rounds"),
            F.when(ended, F.lit(None).cast("binary")).otherwise(F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            ended.alias("ended"),
        )
        table, new_path = work.table(step, "round", by=["ended"])
        if path:
            work.drop(f"{path}/ended=false")
        work.drop(groups_path)
        path = new_path
        done.append(table.filter("ended").select("doc_id", "text_sha256", "keep_id", "group_size", "n_rounds"))
        state = table.filter("not ended").select("doc_id", "n", "text_sha256", "gid", "rest")
        if state.isEmpty():
            break
        width *= GROWTH
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "n_rounds",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, read_table(spark, sf_dir, "documents")).drop("n_rounds")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.s) AS text_sha256
FROM t JOIN g ON t.s = g.s
"""
