"""A training corpus from raw documents: quality rules, toxicity, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents`` for the rows they keep; the last returns the pieces of the packed sequences. A stage's rows are told by
doc_id, null ids among them: where several rows share an id, they go or stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.exact_dedup import exact_groups
from quillon.llm.near_dedup import near_duplicates
from quillon.llm.packing import pack
from quillon.llm.quality_rules import quality
from quillon.llm.shared import Work, read_table
from quillon.llm.toxicity import toxicity


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among the verdicts'. The plan is the same at every size."""
    kept = verdicts.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept.hint("merge"), docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, quality(spark, docs).filter("kept"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, toxicity(docs, read_table(spark, sf_dir, "labels")).filter("predicted = 0"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, exact_groups(spark, docs).filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, near_duplicates(spark, docs).filter("kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("packing", packing_stage),
]

#: The toxicity stage's decoding and fitted model have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs, work, path = read_table(spark, sf_dir, "documents"), Work(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        before = path
        docs, path = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
