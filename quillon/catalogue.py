"""Every query of the driver's contract for the document engine, each beside the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions import values as V
from quillon.operators import engine as E, indexes as I, tools as X, writes as W
from quillon.plans import model as M
from quillon.sources.collections import DATABASE, TABLE_IDS, Dynamic, Typed, dynamic_documents, table, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return put


def _name(t: str) -> str:
    return f"'{DATABASE}/{t}/' || CAST({TABLE_IDS[t]} AS VARCHAR) AS name"


def _typed(name: str, t: str, where=None, cols: tuple[str, ...] = (), sql: str = "", tail: str = "", **query) -> None:
    """A query over a table, and its SQL: a condition and what follows it."""
    keys = ", ".join([_name(t), *cols])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.run_query(table(spark, sf_dir, t), M.Query(DATABASE, t, where=where, select=cols, **query))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {keys} FROM {t}" + f" WHERE {sql}" * bool(sql) + f" {tail}" * bool(tail)


F_, O_ = M.Field, M.Order
_O = ("o_orderstatus", "o_totalprice")
_BY = "CAST(o_orderkey AS VARCHAR)"

# filters
_typed("q_eq", "orders", F_("o_orderstatus", M.EQ, "F"), _O, "o_orderstatus = 'F'")
_typed("q_eq_and_range", "orders", M.and_(F_("o_orderstatus", M.EQ, "F"), F_("o_totalprice", M.GT, 100000)), _O, "o_orderstatus = 'F' AND o_totalprice > 100000", f"ORDER BY o_totalprice, {_BY} LIMIT 20 OFFSET 10", order_by=(O_("o_totalprice"),), offset=10, limit=20)
_typed("q_lt", "customer", F_("c_acctbal", M.LT, 0), ("c_acctbal",), "c_acctbal < 0")
_typed("q_lte", "part", F_("p_size", M.LE, 5.5), ("p_size",), "p_size <= 5.5")
_typed("q_gt", "customer", F_("c_acctbal", M.GT, 9000), ("c_acctbal",), "c_acctbal > 9000")
_typed("q_gte", "part", F_("p_size", M.GE, 48), ("p_size",), "p_size >= 48")
_typed("q_neq", "customer", F_("c_mktsegment", M.NE, "BUILDING"), ("c_mktsegment",), "c_mktsegment <> 'BUILDING'")
_typed("q_in", "customer", F_("c_mktsegment", M.IN, ["BUILDING", "MACHINERY", None]), ("c_mktsegment",), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_typed("q_not_in", "part", F_("p_size", M.NOT_IN, [1, 2.0, 3, math.nan]), ("p_size",), "p_size NOT IN (1, 2, 3)")
_typed("q_not_in_null", "part", F_("p_size", M.NOT_IN, [1, None]), ("p_size",), "false")
_typed("q_or", "orders", M.or_(F_("o_orderstatus", M.EQ, "P"), F_("o_totalprice", M.LT, 2000)), _O, "o_orderstatus = 'P' OR o_totalprice < 2000")
_typed("q_and_or_nested", "orders", M.and_(F_("o_orderpriority", M.EQ, "1-URGENT"), M.or_(F_("o_orderstatus", M.EQ, "P"), M.and_(F_("o_totalprice", M.GE, 1000), F_("o_totalprice", M.LT, 50000.5)))), _O, "o_orderpriority = '1-URGENT' AND (o_orderstatus = 'P' OR (o_totalprice >= 1000 AND o_totalprice < 50000.5))")
_typed("q_type_mismatch", "orders", M.or_(F_("o_orderstatus", M.GT, 5), F_("o_totalprice", M.EQ, "x")), _O, "false")
_typed("q_type_mismatch_neq", "nation", F_("n_name", M.NE, 5), ("n_name",), "n_name IS NOT NULL")
_typed("q_missing_field", "nation", F_("n_nothing", M.NE, 5), ("n_name",), "false")
_typed("q_is_null", "nation", F_("n_name", M.IS_NULL), ("n_name",), "n_name IS NULL")
_typed("q_is_not_null", "nation", F_("n_name", M.IS_NOT_NULL), ("n_name",), "n_name IS NOT NULL")
_typed("q_is_nan", "supplier", F_("s_acctbal", M.IS_NAN), ("s_acctbal",), "isnan(s_acctbal)")
_typed("q_is_not_nan", "supplier", F_("s_acctbal", M.IS_NOT_NAN), ("s_acctbal",), "NOT isnan(s_acctbal)")
_typed("q_timestamp_range", "orders", M.and_(F_("o_orderdate", M.GE, V.parse_timestamp("1995-01-01T00:00:00Z")), F_("o_orderdate", M.LT, V.parse_timestamp("1995-03-01T00:00:00Z"))), ("o_totalprice",), "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'")
_typed("q_empty_and", "region", M.and_(), ("r_name",))
_typed("q_empty_or", "region", M.or_(), ("r_name",), "false")
_typed("q_name_range", "customer", M.and_(F_(M.NAME, M.GE, "10"), F_(M.NAME, M.LT, "11")), ("c_name",), "CAST(c_custkey AS VARCHAR) >= '10' AND CAST(c_custkey AS VARCHAR) < '11'")
_typed("q_name_in", "customer", F_(M.NAME, M.IN, ["1", "22", "nobody"]), ("c_name",), "CAST(c_custkey AS VARCHAR) IN ('1', '22', 'nobody')")
# ordering, cursors, pages
_typed("q_order_desc", "orders", None, _O, "", f"ORDER BY o_totalprice DESC, {_BY} DESC LIMIT 50", order_by=(O_("o_totalprice", M.DESC),), limit=50)
_typed("q_order_two", "part", None, ("p_brand", "p_size"), "", "ORDER BY p_brand, p_size DESC, CAST(p_partkey AS VARCHAR) DESC LIMIT 100", order_by=(O_("p_brand"), O_("p_size", M.DESC)), limit=100)
_typed("q_order_name_desc", "nation", None, ("n_name",), "", "ORDER BY CAST(n_nationkey AS VARCHAR) DESC LIMIT 7", order_by=(O_(M.NAME, M.DESC),), limit=7)
_typed("q_order_missing", "nation", None, ("n_name",), "false", order_by=(O_("n_nothing"),))
_typed("q_implicit_order", "orders", M.and_(F_("o_orderstatus", M.EQ, "O"), F_("o_totalprice", M.GT, 200000)), _O, "o_orderstatus = 'O' AND o_totalprice > 200000", f"ORDER BY o_totalprice, {_BY} LIMIT 25", limit=25)
_typed("q_start_at", "part", None, ("p_size",), "p_size >= 40", "ORDER BY p_size, CAST(p_partkey AS VARCHAR) LIMIT 30", order_by=(O_("p_size"),), start=M.start_at(40), limit=30)
_typed("q_start_after", "part", None, ("p_size",), "p_size > 40", "ORDER BY p_size, CAST(p_partkey AS VARCHAR) LIMIT 30", order_by=(O_("p_size"),), start=M.start_after(40), limit=30)
_typed("q_end_at", "part", None, ("p_size",), "p_size <= 3", order_by=(O_("p_size"),), end=M.end_at(3))
_typed("q_end_before", "part", None, ("p_size",), "p_size < 3", order_by=(O_("p_size"),), end=M.end_before(3))
_typed("q_cursor_desc", "part", None, ("p_size",), "p_size <= 10 AND p_size > 8", order_by=(O_("p_size", M.DESC),), start=M.start_at(10), end=M.end_before(8))
_typed("q_cursor_two", "part", None, ("p_brand", "p_size"), "p_brand > 'Brand#3' OR (p_brand = 'Brand#3' AND p_size < 25)", order_by=(O_("p_brand"), O_("p_size", M.DESC)), start=M.start_after("Brand#3", 25))
_typed("q_cursor_name", "customer", None, ("c_mktsegment",), "c_mktsegment > 'FURNITURE' OR (c_mktsegment = 'FURNITURE' AND CAST(c_custkey AS VARCHAR) >= '5')", order_by=(O_("c_mktsegment"),), start=M.start_at("FURNITURE", "5"))
_typed("q_cursor_other_type", "part", None, ("p_size",), "true", order_by=(O_("p_size"),), start=M.start_at(None), end=M.end_at("text"))
_typed("q_offset_limit", "customer", None, ("c_acctbal",), "", "ORDER BY c_acctbal, CAST(c_custkey AS VARCHAR) LIMIT 15 OFFSET 30", order_by=(O_("c_acctbal"),), offset=30, limit=15)
_typed("q_limit_zero", "customer", None, ("c_acctbal",), "false", limit=0)
_typed("q_projection", "supplier", None, ("s_name", "s_nationkey"))
_typed("q_keys_only", "supplier", None, ())


@_add("q_flagship", f"SELECT {_name('orders')}, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice, {_BY} LIMIT 20 OFFSET 10")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = M.and_(F_("o_orderstatus", M.EQ, "F"), F_("o_totalprice", M.GT, 100000))
    return E.run_query(table(spark, sf_dir, "orders"), M.Query(DATABASE, "orders", where=where, order_by=(O_("o_totalprice"),), offset=10, limit=20, select=("o_orderkey", "o_totalprice")))


@_add("q_json", f"SELECT {_name('orders')}, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 150000.5 ORDER BY o_totalprice DESC, {_BY} DESC LIMIT 12")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {
        "from": [{"collectionId": "orders"}],
        "where": {"compositeFilter": {"op": "AND", "filters": [
            {"fieldFilter": {"field": {"fieldPath": "o_orderstatus"}, "op": "EQUAL", "value": {"stringValue": "P"}}},
            {"fieldFilter": {"field": {"fieldPath": "o_totalprice"}, "op": "GREATER_THAN_OR_EQUAL", "value": {"doubleValue": 150000.5}}}]}},
        "orderBy": [{"field": {"fieldPath": "o_totalprice"}, "direction": "DESCENDING"}], "limit": {"value": 12}, "select": {"fields": [{"fieldPath": "o_totalprice"}]},
    }
    return E.run_query(table(spark, sf_dir, "orders"), M.query_from_json(DATABASE, q))


@_add("q_limit_to_last", f"SELECT * FROM (SELECT {_name('customer')}, c_acctbal FROM customer ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) DESC LIMIT 9)")
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_rows(table(spark, sf_dir, "customer"), M.Query(DATABASE, "customer", order_by=(O_("c_acctbal"),), limit=9, select=("c_acctbal",)))


@_add("q_snapshot_cursor", f"SELECT {_name('nation')}, n_regionkey FROM nation, (SELECT n_regionkey AS r FROM nation WHERE n_nationkey = 12) WHERE n_regionkey > r OR (n_regionkey = r AND CAST(n_nationkey AS VARCHAR) > '12')")
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, q = table(spark, sf_dir, "nation"), M.Query(DATABASE, "nation", order_by=(O_("n_regionkey"),), select=("n_regionkey",))
    at = E.cursor_of(source, q, f"{DATABASE}/nation/12")
    return E.run_query(source, M.replace(q, start=M.start_after(*at)))


def _events(spark: SparkSession, sf_dir: str) -> Typed:
    source = table(spark, sf_dir, "events")
    source.extra = {"props.k": F.get_json_object("props", "$.k").try_cast("long")}
    return source


@_add("q_nested_path", f"SELECT {_name('events')}, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_query(_events(spark, sf_dir), M.Query(DATABASE, "events", where=F_("props.k", M.GE, 90), select=("props.k",)))


def _tagged_documents(spark: SparkSession, sf_dir: str) -> Typed:
    source = table(spark, sf_dir, "documents")
    source.extra = {"tags": F.array("lang", "source")}
    return source


@_add("q_array_contains", f"SELECT {_name('documents')}, n_chars FROM documents WHERE list_contains([lang, source], 'src3')")
def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_query(_tagged_documents(spark, sf_dir), M.Query(DATABASE, "documents", where=F_("tags", M.CONTAINS, "src3"), select=("n_chars",)))


@_add("q_array_contains_any", f"SELECT {_name('documents')}, n_chars FROM documents WHERE list_has_any([lang, source], ['src3', 'de'])")
def _contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_query(_tagged_documents(spark, sf_dir), M.Query(DATABASE, "documents", where=F_("tags", M.CONTAINS_ANY, ["src3", "de", None, 7]), select=("n_chars",)))


_TURN = f"'{DATABASE}/conversations/' || CAST(conv_id AS VARCHAR) || '/turns/' || CAST(turn AS VARCHAR) AS name"


@_add("q_collection_group", f"SELECT {_TURN}, role FROM conversations WHERE turn = 1 ORDER BY '{DATABASE}/conversations/' || CAST(conv_id AS VARCHAR) LIMIT 40")
def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_query(turns(spark, sf_dir), M.Query(DATABASE, "turns", True, where=F_("turn", M.EQ, 1), limit=40, select=("role",)))


@_add("q_one_parent", f"SELECT {_TURN}, role FROM conversations WHERE conv_id = 3")
def _one_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_query(turns(spark, sf_dir), M.Query(f"{DATABASE}/conversations/3", "turns", select=("role",)))


# counts


@_add("q_count", "SELECT count(*) AS count FROM orders")
def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_count(table(spark, sf_dir, "orders"), M.Query(DATABASE, "orders"))


@_add("q_count_filtered", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_count(table(spark, sf_dir, "orders"), M.Query(DATABASE, "orders", where=M.and_(F_("o_orderstatus", M.EQ, "F"), F_("o_totalprice", M.GT, 100000))))


@_add("q_count_lineitem", "SELECT count(*) AS count FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag IN ('A', 'R')")
def _count_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Typed(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "lineitem", F.col("l_orderkey"))
    return E.run_count(lines, M.Query(DATABASE, "lineitem", where=M.and_(F_("l_discount", M.GE, 0.05), F_("l_returnflag", M.IN, ["A", "R"]))))


@_add("q_count_up_to", "SELECT least(count(*), 17) AS count FROM orders")
def _count_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_count(table(spark, sf_dir, "orders"), M.Query(DATABASE, "orders"), up_to=17)


@_add("q_count_page", "SELECT least(greatest(count(*) - 5, 0), 30) AS count FROM customer WHERE c_acctbal < 0")
def _count_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_count(table(spark, sf_dir, "customer"), M.Query(DATABASE, "customer", where=F_("c_acctbal", M.LT, 0), offset=5, limit=30))


@_add("q_count_aliases", "SELECT count(*) AS whole, least(count(*), 3) AS three FROM region")
def _count_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.aggregate(table(spark, sf_dir, "region"), M.Query(DATABASE, "region"), {"whole": None, "three": 3})


# lookups and listings


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent_path, collection_id, name and size of the documents of three collections."""
    parts = [table(spark, sf_dir, t) for t in ("nation", "region")]
    out = turns(spark, sf_dir)
    parts.append(out)
    text = {"nation": "n_name", "region": "r_name", "turns": "text"}
    frames = [s.df.select(s.parent_column.alias("parent_path"), F.lit(s.collection_id).alias("collection_id"), s.name.alias("name"), X.size_of("string", F.col(text[s.collection_id])).alias("size")) for s in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


_DIRECTORY = f"""(SELECT '{DATABASE}' AS parent_path, 'nation' AS collection_id, octet_length(encode(n_name)) + 2 AS size FROM nation
UNION ALL SELECT '{DATABASE}', 'region', octet_length(encode(r_name)) + 2 FROM region
UNION ALL SELECT '{DATABASE}/conversations/' || CAST(conv_id AS VARCHAR), 'turns', octet_length(encode(text)) + 2 FROM conversations)"""


@_add("q_batch_get", f"SELECT CAST(pos AS INTEGER) AS pos, '{DATABASE}/nation/' || id AS name, n_nationkey IS NOT NULL AS found, n_name FROM (VALUES (0, '7'), (1, 'x'), (2, '3'), (3, '7')) r(pos, id) LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = id")
def _batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(i, f"{DATABASE}/nation/{x}") for i, x in enumerate(["7", "x", "3", "7"])], "pos int, name string")
    return E.batch_get(table(spark, sf_dir, "nation"), wanted).select("pos", "name", "found", "n_name")


@_add("q_multi_get", f"SELECT {_name('nation')}, n_name FROM nation WHERE n_nationkey IN (1, 4)")
def _multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(f"{DATABASE}/nation/{x}",) for x in (1, 4, 4, 999)], "name string")
    return E.get_documents(table(spark, sf_dir, "nation"), wanted).select("name", "n_name")


@_add("q_list_collections", f"SELECT DISTINCT collection_id FROM {_DIRECTORY} WHERE parent_path = '{DATABASE}'")
def _list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.list_collection_ids(_directory(spark, sf_dir), DATABASE)


@_add("q_collections", f"SELECT DISTINCT collection_id FROM {_DIRECTORY}")
def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.collections_with_documents(_directory(spark, sf_dir))


@_add("q_stats", f"SELECT collection_id, count(*) AS docs, CAST(sum(size) AS BIGINT) AS bytes FROM {_DIRECTORY} GROUP BY collection_id")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.statistics(_directory(spark, sf_dir), F.col("size"))


@_add("q_count_collection", f"SELECT count(*) AS docs FROM {_DIRECTORY} WHERE collection_id = 'turns'")
def _count_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.count_collection(_directory(spark, sf_dir), "turns")


@_add("q_page_capped", f"SELECT name, size, capped FROM (SELECT *, bool_or(NOT fits) OVER () AS capped FROM (SELECT *, upto <= 4000 OR upto = size AS fits FROM (SELECT *, sum(size) OVER (ORDER BY name) AS upto FROM (SELECT {_TURN}, octet_length(encode(text)) + 2 AS size FROM conversations ORDER BY name LIMIT 300)))) WHERE fits")
def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _directory(spark, sf_dir).filter("collection_id = 'turns'").select("name", "size")
    return E.page_after(docs, None, 300, 4000, F.col("size"))


# comparing


def _two_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    copy = source.filter("c_custkey % 50 <> 7").withColumn("c_acctbal", F.when(F.col("c_custkey") % 40 == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return source, copy


@_add("q_verify", "SELECT count(*) AS source, count(*) FILTER (c_custkey % 50 <> 7) AS checked, count(*) FILTER (c_custkey % 50 = 7) AS missing, count(*) FILTER (c_custkey % 50 <> 7 AND c_custkey % 40 = 3) AS mismatch FROM customer")
def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.verify(*_two_copies(spark, sf_dir), "c_custkey", ["c_acctbal", "c_mktsegment"])


@_add("q_verify_missing", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 7")
def _verify_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.missing(*_two_copies(spark, sf_dir), "c_custkey")


@_add("q_verify_mismatch", "SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7 AND c_custkey % 40 = 3")
def _verify_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mismatches(*_two_copies(spark, sf_dir), "c_custkey", ["c_acctbal", "c_mktsegment"])


@_add("q_every_nth", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) WHERE (i - 1) % 10 = 0")
def _nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.every_nth(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", 10)


@_add("q_copy_missing_ids", "SELECT CAST(k AS BIGINT) AS c_custkey FROM (VALUES (1), (5), (-3), (99999999)) v(k) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def _copy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(1,), (5,), (-3,), (99999999,)], "c_custkey long")
    return X.copy_ids(spark.read.parquet(f"{sf_dir}/customer.parquet"), ids, "c_custkey")[1]


# transforms of native columns


@_add("q_increment", "SELECT c_custkey, c_custkey + 5 AS i, c_acctbal + 0.5 AS d FROM customer")
def _increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.select("c_custkey", W.increment_column(F.col("c_custkey"), 5, True).alias("i"), W.increment_column(F.col("c_acctbal"), 0.5, False).alias("d"))


@_add("q_maximum", "SELECT p_partkey, greatest(p_size, 25) AS m FROM part")
def _maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", W.extremum_column(F.col("p_size"), 25, 1).alias("m"))


@_add("q_minimum", "SELECT p_partkey, least(p_size, 25) AS m FROM part")
def _minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", W.extremum_column(F.col("p_size"), 25, -1).alias("m"))


@_add("q_array_union", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN [1, 1, 9] WHEN n_regionkey = 9 THEN [9, 9, 1] ELSE [n_regionkey, n_regionkey, 1, 9] END AS a FROM nation")
def _array_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", W.array_union_column(F.array("n_regionkey", "n_regionkey"), [1, 9, 1]).alias("a"))


@_add("q_array_remove", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN [7, 7] ELSE [n_regionkey, 7, n_regionkey, 7] END AS a FROM nation")
def _array_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", W.array_remove_column(F.array("n_regionkey", F.lit(7), "n_regionkey", F.lit(7)), [1, 5555]).alias("a"))


@_add("q_merge_mask", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new ' || n_nationkey ELSE n_name END AS n_name, CASE WHEN n_nationkey >= 5 THEN n_regionkey END AS n_regionkey FROM nation")
def _merge_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    updates = df.filter("n_nationkey < 5").select("n_nationkey", F.concat(F.lit("new "), F.col("n_nationkey")).alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"))
    return W.merge_columns(df, "n_nationkey", updates, ["n_name", "n_regionkey"])


# schemaless documents: one of each kind of value

_MIXED = {"int": 5, "double": 5.0, "nine": 9, "text": "zzz", "null": None, "nan": math.nan, "array": [5, "a"], "flag": True, "bytes": b"\x01", "when": V.Timestamp(0), "map": {"k": 1}, "ref": V.Ref(f"{DATABASE}/t/int"), "here": V.Geo(1.0, 2.0), "big": (1 << 53) + 1, "bigger": float(1 << 53)}


def mixed(spark: SparkSession) -> Dynamic:
    docs = {f"{DATABASE}/t/{k}": {"x": v, "n": {"x": v}} for k, v in _MIXED.items()} | {f"{DATABASE}/t/missing": {"y": 1}}
    return Dynamic(dynamic_documents(spark, docs), "t")


_REST = ["nine", "text", "array", "flag", "bytes", "when", "map", "ref", "here", "big", "bigger"]
#: Filters on x, and the documents they let through.
_TRUTH = {
    "eq_5": (F_("x", M.EQ, 5), ["int", "double"]),
    "eq_nan": (F_("x", M.EQ, math.nan), ["nan"]),
    "eq_null": (F_("x", M.EQ, None), ["null"]),
    "eq_array": (F_("x", M.EQ, [5.0, "a"]), ["array"]),
    "eq_map": (F_("x", M.EQ, {"k": 1.0}), ["map"]),
    "eq_geo": (F_("x", M.EQ, V.Geo(1.0, 2.0)), ["here"]),
    "eq_exact": (F_("x", M.EQ, float(1 << 53)), ["bigger"]),
    "neq_5": (F_("x", M.NE, 5), ["nan", *_REST]),
    "neq_nan": (F_("x", M.NE, math.nan), ["int", "double", *_REST]),
    "neq_null": (F_("x", M.NE, None), ["int", "double", "nan", *_REST]),
    "gt_4": (F_("x", M.GT, 4), ["int", "double", "nine", "big", "bigger"]),
    "gt_exact": (F_("x", M.GT, float(1 << 53)), ["big"]),
    "lt_text": (F_("x", M.LT, "zzzz"), ["text"]),
    "lte_flag": (F_("x", M.LE, True), ["flag"]),
    "gte_bytes": (F_("x", M.GE, b""), ["bytes"]),
    "gte_array": (F_("x", M.GE, []), ["array"]),
    "lt_nan": (F_("x", M.LT, math.nan), []),
    "in_5_null": (F_("x", M.IN, [5, None]), ["int", "double"]),
    "in_nan": (F_("x", M.IN, [math.nan]), []),
    "in_mixed": (F_("x", M.IN, ["zzz", 9.0, True]), ["text", "nine", "flag"]),
    "not_in_5": (F_("x", M.NOT_IN, [5]), ["nan", *_REST]),
    "not_in_nan": (F_("x", M.NOT_IN, [math.nan]), ["int", "double", "nan", *_REST]),
    "not_in_5_null": (F_("x", M.NOT_IN, [5, None]), []),
    "contains_5": (F_("x", M.CONTAINS, 5.0), ["array"]),
    "contains_null": (F_("x", M.CONTAINS, None), []),
    "contains_any": (F_("x", M.CONTAINS_ANY, ["a", None, 77]), ["array"]),
    "is_null": (F_("x", M.IS_NULL), ["null"]),
    "is_not_null": (F_("x", M.IS_NOT_NULL), ["int", "double", "nan", *_REST]),
    "is_nan": (F_("x", M.IS_NAN), ["nan"]),
    "is_not_nan": (F_("x", M.IS_NOT_NAN), ["int", "double", *_REST]),
    "nested": (F_("n.x", M.EQ, "zzz"), ["text"]),
    "quoted": (F_("`n`.`x`", M.EQ, 9), ["nine"]),
    "bad_path": (F_("n..x", M.EQ, 9), []),
    "unknown_op": (F_("x", "like", 9), []),
}


def _truth(name: str, where, expected: list[str]) -> None:
    names = ", ".join(f"('{DATABASE}/t/{k}')" for k in expected)
    QUERIES[f"q_truth_{name}"] = lambda spark, sf_dir: E.run_query(mixed(spark), M.Query(DATABASE, "t", where=where, order_by=(O_(M.NAME),), select=())).select("name")
    ORACLE_SQL[f"q_truth_{name}"] = f"SELECT name FROM (VALUES {names}) v(name)" if expected else "SELECT '' AS name WHERE false"


for _n, (_w, _e) in _TRUTH.items():
    _truth(_n, _w, _e)

_ORDER = ["null", "flag", "nan", "double", "int", "nine", "bigger", "big", "when", "text", "bytes", "ref", "here", "array", "map"]


@_add("q_type_order", "SELECT CAST(i AS INTEGER) AS i, name FROM (VALUES " + ", ".join(f"({i}, '{DATABASE}/t/{k}')" for i, k in enumerate(_ORDER)) + ") v(i, name)")
def _type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.run_query(mixed(spark), M.Query(DATABASE, "t", order_by=(O_("x"),), select=())).select("name").collect()
    return spark.createDataFrame([(i, r.name) for i, r in enumerate(rows)], "i int, name string")


@_add("q_type_cursor", "SELECT name FROM (VALUES " + ", ".join(f"('{DATABASE}/t/{k}')" for k in _ORDER[5:11]) + ") v(name)")
def _type_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_query(mixed(spark), M.Query(DATABASE, "t", order_by=(O_("x"),), start=M.start_after(5), end=M.end_before(V.Ref("a")), select=())).select("name")


@_add("q_projection_dynamic", f"SELECT '{DATABASE}/t/text' AS name, '{{\"n\":{{\"m\":{{\"x\":{{\"s\":\"zzz\"}}}}}}}}' AS data")
def _projection_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_query(mixed(spark), M.Query(DATABASE, "t", where=F_("x", M.EQ, "zzz"), select=("n.x", "nothing", M.NAME)))


# indexes and changes


@_add("q_index_contains", "SELECT name, CAST(count(*) AS BIGINT) AS entries FROM (SELECT DISTINCT doc_id, 't' || unnest([lang, source, lang]) AS e, CAST(doc_id AS VARCHAR) AS name FROM documents) GROUP BY name")
def _index_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    el = lambda c: F.concat(F.lit('{"s":"'), F.col(c), F.lit('"}'))
    data = F.concat(F.lit('{"tags":{"a":['), F.concat_ws(",", el("lang"), el("source"), el("lang")), F.lit("]}}"))
    dynamic = docs.select(F.col("doc_id").cast("string").alias("name"), F.lit(DATABASE).alias("parent_path"), F.lit("d").alias("collection_id"), data.alias("data"))
    return I.key_rows(I.parse_spec("d|tags contains"), dynamic).groupBy("name").agg(F.count(F.lit(1)).alias("entries"))


@_add("q_indexed", f"SELECT '{DATABASE}/n/' || CAST(n_nationkey AS VARCHAR) AS name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey DESC LIMIT 3")
def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    data = F.concat(F.lit('{"r":{"i":"'), F.col("n_regionkey"), F.lit('"},"k":{"i":"'), F.col("n_nationkey"), F.lit('"}}'))
    key = F.col("n_nationkey").cast("string")
    docs = nation.select(F.concat(F.lit(f"{DATABASE}/n/"), key).alias("name"), F.lit(DATABASE).alias("parent_path"), F.lit("n").alias("collection_id"), key.alias("doc_id"), data.alias("data"))
    index, q = I.parse_spec("n|r asc|k desc"), M.Query(DATABASE, "n", where=F_("r", M.EQ, 2), order_by=(O_("k", M.DESC),), limit=3, select=())
    plan = I.choose(q, [index], {index.id})
    return I.run_indexed(plan, I.key_rows(index, docs), Dynamic(docs, "n"), q).select("name")


@_add("q_change_feed", "SELECT event_id AS seq, user_id AS xid FROM events WHERE event_type = 'click' AND (user_id > 20 OR (user_id = 20 AND event_id > 100)) AND user_id < 60 ORDER BY user_id, event_id LIMIT 50")
def _change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.streaming.changes import read_changes

    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("xid"), F.col("event_type").alias("collection_id"))
    return read_changes(log, (20, 100), "click", 50, 60).select("seq", "xid")
