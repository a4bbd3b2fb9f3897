"""Reads: structured queries, counts, lookups, listings and statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from quillon.functions import values as V
from quillon.plans.compiler import Compiler
from quillon.plans.model import InvalidQuery, Query, analyse
from quillon.sources.collections import Dynamic, Typed


#: Queries by how they were answered, so that tests can tell that a path was taken.
PATHS: Counter[str] = Counter()


def run_query(source: Typed | Dynamic, query: Query) -> DataFrame:
    """The query's documents in order: ``name`` and the selected fields."""
    PATHS["typed" if isinstance(source, Typed) else "dynamic"] += 1
    c = Compiler(source, analyse(query))
    return c.projected(c.paged(c.matching()))


def run_count(source: Typed | Dynamic, query: Query, up_to: int | None = None, alias: str = "count") -> DataFrame:
    """One row with the number of the query's documents, ``up_to`` at most. Nothing is sorted; limits act before the count."""
    return aggregate(source, query, {alias: up_to})


def aggregate(source: Typed | Dynamic, query: Query, counts: dict[str, int | None]) -> DataFrame:
    """One row with a count for each alias, each with its own bound."""
    if any(n is not None and n <= 0 for n in counts.values()):
        raise InvalidQuery("a count's bound is positive")
    q = analyse(query)
    df = Compiler(source, q).matching()
    bounds = [n for n in counts.values()]
    most = None if None in bounds or not bounds else max(bounds)
    limit = min([n for n in (most, q.limit) if n is not None], default=None)
    if limit is not None:
        df = df.limit(limit + q.offset)
    n = F.greatest(F.count(F.lit(1)) - F.lit(q.offset), F.lit(0))
    n = n if q.limit is None else F.least(n, F.lit(q.limit))
    return df.agg(*[(n if up_to is None else F.least(n, F.lit(up_to))).cast("long").alias(a) for a, up_to in counts.items()])


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows in order, a partition at a time; stop whenever the consumer has enough."""
    yield from df.toLocalIterator(prefetchPartitions=False)


def last_rows(source: Typed | Dynamic, query: Query) -> DataFrame:
    """The last ``limit`` rows of a query, in its own order."""
    from quillon.plans.model import reversed_order

    c, back = Compiler(source, analyse(query)), Compiler(source, reversed_order(query))
    return c.projected(back.paged(back.matching()).orderBy(*c.ordering()))


def cursor_of(source: Typed | Dynamic, query: Query, name: str) -> tuple:
    """The values of a document at the query's ordering, to start or end a page at it."""
    q = analyse(query)
    c = Compiler(source, q)
    df = source.scan(q.parent, q.all_descendants)
    if isinstance(source, Dynamic):
        row = df.filter(F.col("name") == name).select("data").first()
        if row is None:
            raise InvalidQuery(f"no document {name}")
        from quillon.functions.fieldpath import NAME, get, parse

        fields = V.loads(row.data)
        return tuple(V.Ref(name) if o.path == NAME else get(fields, parse(o.path))[0] for o in q.order_by)
    cols = [source.name if o.path == "__name__" else source.column(o.path)[0] for o in q.order_by]
    row = df.filter(source.name == name).select(*[x.alias(str(i)) for i, x in enumerate(cols)]).first()
    if row is None:
        raise InvalidQuery(f"no document {name}")
    import datetime as dt

    return tuple(V.Ref(x) if o.path == "__name__" else V.timestamp(x) if isinstance(x, dt.datetime) else bytes(x) if isinstance(x, bytearray) else x for o, x in zip(q.order_by, row, strict=True)) if c else ()


def get_documents(source: Typed | Dynamic, names: DataFrame) -> DataFrame:
    """Documents whose name is in ``names`` (column name); missing ones are absent."""
    docs = source.df.withColumn("name", source.name) if isinstance(source, Typed) else source.df
    return docs.join(names.select("name").distinct(), "name", "left_semi")


def batch_get(source: Typed | Dynamic, requests: DataFrame) -> DataFrame:
    """For each request (pos, name) in order: found, and the document's columns, null where it is missing."""
    docs = source.df.withColumn("_name", source.name) if isinstance(source, Typed) else source.df.withColumnRenamed("name", "_name")
    docs = docs.withColumn("_found", F.lit(True))
    joined = requests.join(docs, requests["name"] == docs["_name"], "left")
    fields = [c for c in docs.columns if c not in ("_name", "_found")]
    return joined.select("pos", requests["name"], F.coalesce("_found", F.lit(False)).alias("found"), *fields).orderBy("pos")


def list_collection_ids(documents: DataFrame, parent: str) -> DataFrame:
    """Ids of the collections right under a parent, sorted."""
    return documents.filter(F.col("parent_path") == parent).select("collection_id").distinct().orderBy("collection_id")


def collections_with_documents(documents: DataFrame) -> DataFrame:
    return documents.select("collection_id").distinct()


def statistics(documents: DataFrame, size: Column) -> DataFrame:
    """Documents and bytes of each collection, most documents first."""
    return documents.groupBy("collection_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(size).cast("long").alias("bytes")).orderBy(F.desc("docs"), "collection_id")


def count_collection(documents: DataFrame, collection_id: str) -> DataFrame:
    return documents.filter(F.col("collection_id") == collection_id).agg(F.count(F.lit(1)).alias("docs"))


def sample_names(documents: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` random names; each task keeps its first n only."""
    return documents.select("name", F.rand(seed).alias("_r")).orderBy("_r").limit(n).select("name")


def page_after(documents: DataFrame, last: str | None, rows: int, max_bytes: int, size: Column) -> DataFrame:
    """The next documents by name, ``rows`` and ``max_bytes`` at most but one at least; ``capped`` where bytes ended the page.

    A page is bounded by ``rows``, so the running sum over it sees no more than that.
    """
    df = documents if last is None else documents.filter(F.col("name") > last)
    page = df.orderBy("name").limit(rows).withColumn("_size", size)
    upto = F.sum("_size").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    page = page.withColumn("_upto", upto)
    fits = (F.col("_upto") <= max_bytes) | (F.col("_upto") == F.col("_size"))
    capped = F.max(~fits).over(Window.partitionBy())
    return page.withColumns({"_fits": fits, "capped": capped}).filter("_fits").drop("_size", "_upto", "_fits")


def register(spark: SparkSession, source: Typed | Dynamic, view: str) -> None:
    """The collection as a SQL view, with its documents' names."""
    (source.df.withColumn("name", source.name) if isinstance(source, Typed) else source.df).createOrReplaceTempView(view)
