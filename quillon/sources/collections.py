"""Collections of documents as DataFrames.

Typed: an ordinary Parquet table; one column is the id, other columns or expressions are fields. Predicates stay on raw
columns, so they reach the scan. Dynamic: name, parent_path, collection_id, doc_id and ``data``, the tagged JSON of a
document's fields, read as a variant from which only the paths in use are taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillon.functions.fieldpath import parse, render

DATABASE = "projects/local/databases/main/documents"
DYNAMIC_SCHEMA = "name string, parent_path string, collection_id string, doc_id string, data string, create_time timestamp, update_time timestamp, version long"


@dataclass
class Typed:
    """``null_means``: whether a null column is a missing field or a field that is null. ``parent``: where the collection
    hangs, a path or, for collections under many documents, a Column. ``extra``: fields by path beyond the columns."""

    df: DataFrame
    collection_id: str
    doc_id: Column
    parent: str | Column = DATABASE
    null_means: str = "missing"
    extra: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.null_means not in ("missing", "null"):
            raise ValueError("null_means is 'missing' or 'null'")

    @property
    def parent_column(self) -> Column:
        return F.lit(self.parent) if isinstance(self.parent, str) else self.parent

    @property
    def name(self) -> Column:
        return F.concat_ws("/", self.parent_column, F.lit(self.collection_id), self.doc_id.cast("string"))

    def scan(self, parent: str, all_descendants: bool) -> DataFrame:
        """Documents of the collection under a parent, directly or at any depth."""
        if isinstance(self.parent, str):
            inside = self.parent == parent or (all_descendants and self.parent.startswith(parent + "/"))
            return self.df if inside else self.df.filter(F.lit(False))
        here = self.parent == parent
        return self.df.filter((here | self.parent.startswith(parent + "/")) if all_descendants else here)

    def column(self, path: str) -> tuple[Column, str] | None:
        """The Column of a field and its Spark type; None where the schema has no such field."""
        if path in self.extra:
            return self.extra[path], self.df.select(self.extra[path].alias("x")).schema["x"].dataType.simpleString()
        segments, kind = parse(path), self.df.schema
        for s in segments:
            if not isinstance(kind, T.StructType) or s not in kind.fieldNames():
                return None
            kind = kind[s].dataType
        col = F.col(f"`{segments[0]}`")
        for s in segments[1:]:
            col = col.getField(s)
        return col, kind.simpleString()

    def fields(self) -> list[str]:
        return [render([c]) for c in self.df.columns] + [p for p in self.extra if p not in self.df.columns]


@dataclass
class Dynamic:
    """``df`` has the columns of DYNAMIC_SCHEMA, of which the first five are needed; several collections may share it."""

    df: DataFrame
    collection_id: str

    @property
    def name(self) -> Column:
        return F.col("name")

    def scan(self, parent: str, all_descendants: bool) -> DataFrame:
        df = self.df.filter(F.col("collection_id") == self.collection_id)
        return df.filter(F.col("name").startswith(parent + "/") if all_descendants else F.col("parent_path") == parent)


def dynamic_documents(spark: SparkSession, documents: dict[str, dict]) -> DataFrame:
    """A dynamic table of a few documents by name, for fixtures and small writes."""
    from quillon.functions.values import document_name, dumps

    rows = [(n, d.parent_path, d.collection_id, d.doc_id, dumps(f)) for n, f in documents.items() for d in [document_name(n)]]
    return spark.createDataFrame(rows, "name string, parent_path string, collection_id string, doc_id string, data string")


def turns(spark: SparkSession, sf_dir: str) -> Typed:
    """conversations/{conv_id}/turns/{turn}: a collection under many documents."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return Typed(df, "turns", F.col("turn"), F.concat(F.lit(f"{DATABASE}/conversations/"), F.col("conv_id").cast("string")))


# The id column of each table.
TABLE_IDS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
}


def table(spark: SparkSession, sf_dir: str, name: str, **options) -> Typed:
    """A table as a collection of its name."""
    return Typed(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, F.col(TABLE_IDS[name]), **options)
