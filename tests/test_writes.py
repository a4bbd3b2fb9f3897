"""Writes, commits, transactions, the change feed, indexes and tools."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import fieldpath, values as V
from quillon.operators import engine as E, indexes as I, tools as X, writes as W
from quillon.operators.store import Store
from quillon.plans import model as M
from quillon.sources.collections import DATABASE, Dynamic, Typed, dynamic_documents
from quillon.streaming.changes import follow, read_changes

NOW = V.Timestamp(1_700_000_000_000_000)


def name(i):
    return f"{DATABASE}/c/{i}"


def test_masks_and_transforms():
    s, _ = W.apply_write(W.State(), W.Write(name(1), fields={"a": 1, "n": {"x": "k", "y": 2}, "t": [1, 1, None]}), NOW)
    later = V.Timestamp(NOW.micros + 5)
    s, _ = W.apply_write(s, W.Write(name(1), fields={"n": {"x": "new"}}, mask=("n.x", "n.y", "b")), later)
    assert s.fields == {"a": 1, "n": {"x": "new"}, "t": [1, 1, None]} and s.create_time == NOW and s.update_time == later
    todo = (
        W.Transform("a", W.INCREMENT, V.INT_MAX), W.Transform("d", W.INCREMENT, 1.5), W.Transform("t", W.ARRAY_UNION, [1.0, None, 7, 7]), W.Transform("u", W.ARRAY_REMOVE, [1]),
        W.Transform("a", W.MAXIMUM, math.nan), W.Transform("d", W.MINIMUM, 1.5), W.Transform("now", W.SERVER_TIME),
    )
    s, results = W.apply_write(s, W.Write(name(1), "transform", transforms=todo), later)
    assert s.fields["t"] == [1, 1, None, 7] and s.fields["u"] == [] and math.isnan(s.fields["a"]) and s.fields["now"] == later
    assert results[0] == V.INT_MAX and results[2] is None and results[3] is None
    s, _ = W.apply_write(s, W.Write(name(1), "transform", transforms=(W.Transform("t", W.ARRAY_REMOVE, [1.0]),)), later)
    assert s.fields["t"] == [None, 7]


def test_preconditions():
    there = W.State({}, NOW, NOW)
    for state, w, code in (
        (W.State(), W.Write(name(1), exists=True), "NOT_FOUND"),
        (there, W.Write(name(1), exists=False), "ALREADY_EXISTS"),
        (there, W.Write(name(1), update_time=V.Timestamp(1)), "FAILED_PRECONDITION"),
        (W.State(), W.Write(name(1), update_time=NOW), "FAILED_PRECONDITION"),
        (there, W.Write(""), "INVALID_ARGUMENT"),
        (there, W.Write(name(1), "delete", transforms=(W.Transform("a", W.SERVER_TIME),)), "INVALID_ARGUMENT"),
    ):
        with pytest.raises(W.WriteError) as e:
            W.apply_write(state, w, NOW)
        assert e.value.code == code
    assert W.load_write(W.dump_write(W.Write(name(1), fields={"a": [1]}, mask=(), exists=True, update_time=NOW))) == W.Write(name(1), fields={"a": [1]}, mask=(), exists=True, update_time=NOW)


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    results, _ = store.commit([W.Write(name(1), fields={"n": 1}), W.Write(name(1), "transform", transforms=(W.Transform("n", W.INCREMENT, 2),)), W.Write(f"{DATABASE}/other/1", fields={"v": 1})])
    assert results == [[], [3], []] and store.get([name(1), name(9)]) == {name(1): {"n": 3}}
    with pytest.raises(W.WriteError):
        store.commit([W.Write(name(2), fields={"n": 1}), W.Write(name(1), exists=False)])
    assert store.get([name(2)]) == {} and store.manifest()["version"] == 1
    token = store.begin()
    store.get([name(1), name(2)], token)
    store.commit([W.Write(name(2), fields={"n": 5})])
    with pytest.raises(W.WriteError) as e:
        store.commit([W.Write(name(1), fields={"n": 0})], token)
    assert e.value.code == "ABORTED"
    with pytest.raises(W.WriteError):
        store.commit([W.Write(name(1), fields={"n": 0})], token)
    assert store.batch_write([W.Write(name(3), fields={}), W.Write(name(3), exists=False), W.Write("x")]) == ["OK", "ALREADY_EXISTS", "INVALID_ARGUMENT"]
    assert store.drop_collection("other") == 1 and store.documents(["other"]).count() == 0
    store.commit([W.Write(name(77), "delete")])
    log = [(r.seq, r.xid, r.doc_name.rsplit("/", 2)[1], r.kind) for r in read_changes(store.changes()).collect()]
    assert log == [(0, 1, "c", "write"), (1, 1, "other", "write"), (2, 2, "c", "write"), (3, 3, "c", "write"), (4, 4, "other", "delete")]
    assert [r.seq for r in read_changes(store.changes(), after=(1, 1), collection_id="c", low_water=3).collect()] == [2]
    seen = []
    for _ in range(2):
        follow(store, f"{tmp_path}/follow", lambda df, n: seen.extend((r.name, r.data is None) for r in df.select("name", "data").collect()), "c")
    assert sorted(set(seen)) == [(name(1), False), (name(2), False), (name(3), False)]
    assert store.prune_changes(1 << 60) == 5 and store.changes().count() == 0


def test_indexes(spark, tmp_path):
    config = """{"indexes": [{"collectionGroup": "posts", "fields": [{"fieldPath": "author", "order": "ASCENDING"}, {"fieldPath": "score", "order": "DESCENDING"}, {"fieldPath": "__name__", "order": "DESCENDING"}]},
    {"collectionGroup": "posts", "fields": [{"fieldPath": "author", "order": "ASCENDING"}, {"fieldPath": "score", "order": "DESCENDING"}]},
    {"collectionGroup": "chats", "queryScope": "COLLECTION_GROUP", "fields": [{"fieldPath": "tags", "arrayConfig": "CONTAINS"}, {"fieldPath": "at", "order": "DESCENDING"}]},
    {"collectionGroup": "v", "fields": [{"fieldPath": "e", "vectorConfig": {"dimension": 3}}]}, {"collectionGroup": "w", "fields": [{"fieldPath": "__name__", "order": "ASCENDING"}]}]}"""
    found, skipped = I.parse_config(config)
    assert [x.spec for x in found] == ["posts|author asc|score desc", "group:chats|tags contains|at desc"] and [c for c, _ in skipped] == ["v", "w"]
    assert all(I.parse_spec(x.spec) == x and 0 <= x.id < 1 << 63 for x in found)
    for bad in ("", "posts", "posts|", "posts|f", "posts|f sideways", "|f asc"):
        with pytest.raises(ValueError):
            I.parse_spec(bad)
    docs = {f"{DATABASE}/posts/p{i}": {"author": "abc"[i % 3], "tags": [i % 4, i % 4, "x"]} | ({"score": i % 7} if i % 13 else {}) for i in range(40)}
    docs[f"{DATABASE}/other/o/posts/p1"] = {"author": "a", "score": 1, "tags": [1]}
    table = dynamic_documents(spark, docs)
    source = Dynamic(table, "posts")
    one, two = I.parse_spec("posts|author asc|score desc"), I.parse_spec("posts|tags contains|score desc")
    entries = {}
    for x in (one, two):
        n = I.build(x, table, f"{tmp_path}/{x.id}", 2)
        entries[x.id] = spark.read.parquet(f"{tmp_path}/{x.id}")
        assert n == entries[x.id].count()
    used = 0
    for q in (
        M.Query(DATABASE, "posts", where=M.Field("author", M.EQ, "a"), order_by=(M.Order("score", M.DESC),), limit=4),
        M.Query(DATABASE, "posts", where=M.and_(M.Field("author", M.EQ, "b"), M.Field("score", M.GT, 2))),
        M.Query(DATABASE, "posts", where=M.Field("author", M.IN, ["a", "c"]), order_by=(M.Order("score"),), offset=2),
        M.Query(DATABASE, "posts", where=M.Field("tags", M.CONTAINS, 1), order_by=(M.Order("score", M.DESC),)),
        M.Query(DATABASE, "posts", where=M.Field("tags", M.CONTAINS_ANY, [1, 2, "x"]), order_by=(M.Order("score", M.DESC),)),
        M.Query(DATABASE, "posts", where=M.Field("author", M.NE, "a"), order_by=(M.Order("author"),)),
        M.Query(DATABASE, "posts", where=M.or_(M.Field("author", M.EQ, "a"), M.Field("score", M.EQ, 1))),
    ):
        plan = I.choose(q, [one, two], {one.id, two.id})
        assert I.choose(q, [one, two], set()) is None
        if plan:
            used += 1
            want = [r.name for r in E.run_query(source, q).collect()]
            assert [r.name for r in I.run_indexed(plan, entries[plan.index.id], source, q).collect()] == want and want
    assert used == 5


def test_index_catalog(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.commit([W.Write(name(i), fields={"a": i % 2, "s": i}) for i in range(8)])
    catalog = I.IndexCatalog(store)
    found, _ = catalog.apply('{"indexes": [{"collectionGroup": "c", "fields": [{"fieldPath": "a", "order": "ASCENDING"}, {"fieldPath": "s", "order": "ASCENDING"}]}, {"collectionGroup": "unused", "fields": [{"fieldPath": "a", "order": "ASCENDING"}]}]}')
    (index,) = found
    q = M.Query(DATABASE, "c", where=M.Field("a", M.EQ, 1), order_by=(M.Order("s"),), select=())
    ask = lambda: ([r.name for r in catalog.run(q).collect()], E.PATHS["indexed"])
    before = E.PATHS["indexed"]
    assert catalog.list() == [(index.spec, False, 0)] and ask() == ([name(i) for i in (1, 3, 5, 7)], before)
    assert catalog.backfill(index, 2) == 8 and ask() == ([name(i) for i in (1, 3, 5, 7)], before + 1)
    store.commit([W.Write(name(2), fields={"a": 1, "s": 2}), W.Write(name(3), "delete"), W.Write(name(9), fields={"a": 1})])
    assert ask() == ([name(i) for i in (1, 2, 5, 7)], before + 1), "an overtaken index is passed over"
    assert catalog.maintain(index) == 7 and ask() == ([name(i) for i in (1, 2, 5, 7)], before + 2)
    assert catalog.drop(index) and not catalog.drop(index) and catalog.list() == []


def test_an_index_with_a_gap_is_never_ready(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.commit([W.Write(name(i), fields={"a": 1, "s": i}) for i in range(3)])
    catalog, index = I.IndexCatalog(store), I.parse_spec("c|a asc|s asc")
    catalog.register([index])
    assert catalog.maintain(index) == 3, "without entries all are made"
    q = M.Query(DATABASE, "c", where=M.Field("a", M.EQ, 1), order_by=(M.Order("s"),), select=())
    store.commit([W.Write(name(5), fields={"a": 1, "s": 5})])
    store.commit([W.Write(name(6), fields={"a": 1, "s": 6})])
    assert catalog.maintain(index) == 5 and [r.name for r in catalog.run(q).collect()] == [name(i) for i in (0, 1, 2, 5, 6)]
    store.commit([W.Write(name(7), fields={"a": 1, "s": 7})])
    store.prune_changes(1 << 60)
    store.commit([W.Write(name(0), "delete")])
    assert catalog.maintain(index) == 5 and [r.name for r in catalog.run(q).collect()] == [name(i) for i in (1, 2, 5, 6, 7)]
    assert index in catalog.ready()


def test_a_stream_between_the_log_and_the_commit_loses_nothing(spark, tmp_path):
    store, seen = Store(spark, f"file://{tmp_path}/db"), {}

    def look():
        follow(store, f"{tmp_path}/cp", lambda df, n: seen.update((r.name, V.loads(r.data)["s"]) for r in df.select("name", "data").collect()))

    store.commit([W.Write(name(1), fields={"s": 1})])
    look()
    swap = store._write_json
    store._write_json = lambda *a: (look(), swap(*a))
    store.commit([W.Write(name(1), fields={"s": 2})])
    store._write_json = swap
    assert seen == {name(1): 1}
    look()
    assert seen == {name(1): 2}
    # a commit that ends before its log is shown
    store.publish_changes, publish = lambda: 0, store.publish_changes
    store.commit([W.Write(name(1), fields={"s": 3})])
    store.publish_changes = publish
    look()
    assert seen == {name(1): 3}


def test_every_nth_of_many_rows(spark):
    df = spark.range(0, 3_000_000, 1, 24).select((F.col("id") * 7919 % 3_000_017).alias("id"))
    ids = sorted(k * 7919 % 3_000_017 for k in range(3_000_000))
    assert sorted(r.id for r in X.every_nth(df, "id", 1000).collect()) == ids[::1000]
    odd = spark.createDataFrame([(None,), ("b",), ("a",), ("c",), ("b",)], "id string")
    assert sorted(r.id for r in X.every_nth(odd, "id", 2).collect()) == ["b", "b", "c"]
    assert X.every_nth(odd.filter("false"), "id", 3).count() == 0


def test_nested_columns_with_nulls_and_structs(spark):
    rows = [(1, [1, None], (1, "x")), (2, [1, 2], (1, None)), (3, None, None), (4, [], (None, "y")), (5, [None], (1, "x"))]
    source = Typed(spark.createDataFrame(rows, "id int, a array<int>, s struct<n:int,t:string>"), "c", F.col("id"))
    ids = lambda **q: [int(r.name.rpartition("/")[2]) for r in E.run_query(source, M.Query(DATABASE, "c", select=(), **q)).collect()]
    assert ids(order_by=(M.Order("a"),)) == [4, 5, 1, 2] and ids(where=M.Field("a", M.EQ, [1, None])) == [1]
    assert ids(where=M.Field("a", M.CONTAINS, 1)) == [1, 2]
    assert ids(where=M.Field("s", M.EQ, {"n": 1, "t": "x"})) == [1, 5] and ids(where=M.Field("s", M.EQ, {"n": 1, "t": None})) == [2]
    assert set(ids(order_by=(M.Order("s"),))) == {1, 2, 4, 5}


def test_a_path_with_both_quotes(spark):
    odd = """a"b'c"""
    df = dynamic_documents(spark, {name(1): {odd: 1}, name(2): {odd: {"x": 1}}, name(3): {"m": {odd: {odd: 1}}}})
    for path, want in (((odd,), [1]), ((odd, "x"), [2]), (("m", odd, odd), [3])):
        q = M.Query(DATABASE, "c", where=M.Field(fieldpath.render(path), M.EQ, 1), select=())
        assert [r.name for r in E.run_query(Dynamic(df, "c"), q).collect()] == [name(i) for i in want]


def test_tools(spark):
    a = dynamic_documents(spark, {name(1): {"n": 1}, name(2): {"x": math.nan, "z": -0.0}, name(3): {"t": "é"}})
    b = dynamic_documents(spark, {name(1): {"n": 1.0}, name(2): {"z": 0.0, "x": math.nan}})
    key = lambda d: d.select("name", X.document_key("data").alias("k"))
    assert tuple(X.verify(key(a), key(b), "name", ["k"]).first()) == (3, 2, 1, 1)
    assert [r.name for r in X.mismatches(key(a), key(b), "name", ["k"]).collect()] == [name(1)]
    assert a.select(X.document_size("data").alias("s")).agg(F.sum("s")).first()[0] == sum(V.size_estimate(x) for x in ({"n": 1}, {"x": 0.5, "z": 0.0}, {"t": "é"}))
    t = [0.0]
    limit = X.RateLimit(100, clock=lambda: t[0], sleep=lambda s: t.__setitem__(0, t[0] + s))
    for n in (60, 40, 1, 500):
        limit.wait(n)
    assert t[0] == 2.0
    assert set(X.bench({"x": lambda: None}, 3, 1)["x"]) == {"p50", "p90", "p95", "p99", "avg"}
    pages, last = [], None
    docs = a.select("name").withColumn("size", F.lit(10))
    while (page := E.page_after(docs, last, 2, 15, F.col("size")).collect()):
        pages.append([r.name for r in page])
        last = page[-1].name
    assert pages == [[name(1)], [name(2)], [name(3)]]
    assert E.sample_names(a, 2).count() == 2
