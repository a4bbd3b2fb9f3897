"""The catalogue against DuckDB; random queries on schemaless documents against plain Python."""

import datetime as dt
import math
import os
import random

import duckdb
import pytest

from quillon import catalogue as C
from quillon.functions import fieldpath as P, values as V
from quillon.operators import engine as E
from quillon.plans import model as M
from quillon.sources.collections import DATABASE, Dynamic, Typed, dynamic_documents

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", [n for n in C.QUERIES if not n.startswith("q_truth") or n.endswith(("5", "nan", "map", "any", "exact"))])
def test_catalogue(spark, sf, duck, name):
    df, rel = C.QUERIES[name](spark, sf), duck.execute(C.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr) == want


def test_every_query_has_sql():
    assert set(C.QUERIES) == set(C.ORACLE_SQL)


def matches(f, name, fields):
    """Filters in plain Python, on the total order."""
    if f is None:
        return True
    if isinstance(f, M.Composite):
        return (all if f.op == M.AND else any)(matches(x, name, fields) for x in f.filters)
    v, there = P.get(fields, P.parse(f.path))
    dull = lambda x: V.bucket(x) in (V.NULL, V.NAN)
    if not there:
        return False
    if f.op == M.EQ:
        return V.equal(v, f.value)
    if f.op == M.NE:
        return v is not None and not V.equal(v, f.value)
    if f.op in (M.LT, M.LE, M.GT, M.GE):
        c = V.compare(v, f.value)
        return V.bucket(v) == V.bucket(f.value) != V.NAN and {M.LT: c < 0, M.LE: c <= 0, M.GT: c > 0, M.GE: c >= 0}[f.op]
    if f.op == M.IN:
        return any(not dull(m) and V.equal(v, m) for m in f.value)
    if f.op == M.NOT_IN:
        return v is not None and None not in f.value and not any(not dull(m) and V.equal(v, m) for m in f.value)
    if f.op == M.CONTAINS:
        return not dull(f.value) and isinstance(v, list) and any(V.equal(e, f.value) for e in v)
    if f.op == M.CONTAINS_ANY:
        return isinstance(v, list) and any(not dull(m) and V.equal(e, m) for e in v for m in f.value)
    return {M.IS_NULL: v is None, M.IS_NOT_NULL: v is not None, M.IS_NAN: V.bucket(v) == V.NAN, M.IS_NOT_NAN: not dull(v)}[f.op]


def answer(docs, q):
    """Names of a query's documents in plain Python."""
    q = M.analyse(q)
    rows = []
    for name, fields in docs.items():
        key = [V.Ref(name) if o.path == M.NAME else P.get(fields, P.parse(o.path)) for o in q.order_by]
        if any(not isinstance(k, V.Ref) and not k[1] for k in key) or not matches(q.where, name, fields):
            continue
        rows.append(([k if isinstance(k, V.Ref) else k[0] for k in key], name))

    def cmp(a, b):
        for o, x, y in zip(q.order_by, a, b, strict=False):
            if c := V.compare(x, y) * (1 if o.direction == M.ASC else -1):
                return c
        return 0

    if q.start:
        rows = [r for r in rows if cmp(r[0], q.start.values) >= (0 if q.start.before else 1)]
    if q.end:
        rows = [r for r in rows if cmp(r[0], q.end.values) <= (-1 if q.end.before else 0)]
    import functools

    rows.sort(key=functools.cmp_to_key(lambda a, b: cmp(a[0], b[0])))
    return [n for _, n in rows[q.offset :]][: q.limit]


VALUES = [None, False, True, math.nan, -math.inf, -1, 0, -0.0, 0.5, 1, 2, 2.0, (1 << 53) + 1, float(1 << 53), V.Timestamp(5), V.Timestamp(7), "", "a", "b", "é", b"", b"\0", V.Ref(f"{DATABASE}/f/a"), V.Geo(1.0, 2.0), [], [1], [1, "x"], {}, {"k": 1}]


def test_random_queries_on_schemaless_documents(spark):
    r = random.Random(20240817)
    docs = {}
    for i in range(70):
        fields = {k: r.choice(VALUES) for k in "ab" if r.random() > 0.12}
        fields["n"] = {"c": r.choice(VALUES)}
        fields["tags"] = r.choice([[r.choice(VALUES[:22]) for _ in range(r.randrange(4))], "none"])
        docs[f"{DATABASE}/f/d{i}"] = fields
    source = Dynamic(dynamic_documents(spark, docs).cache(), "f")
    nonempty = 0
    for k in range(30):
        path, v = r.choice(["a", "b", "n.c"]), r.choice(VALUES)
        order = (M.Order(path, r.choice([M.ASC, M.DESC])),)
        shape = k % 6
        if shape == 0:
            where = M.Field(path, r.choice([M.LT, M.LE, M.GT, M.GE, M.NE, M.EQ]), v)
        elif shape == 1:
            where = M.Field(path, r.choice([M.IN, M.NOT_IN]), r.sample(VALUES, 4))
        elif shape == 2:
            where, order = M.Field("tags", M.CONTAINS, r.choice(VALUES[:22])), ()
        elif shape == 3:
            where, order = M.or_(M.Field("a", M.EQ, v), M.and_(M.Field("tags", M.CONTAINS_ANY, r.sample(VALUES, 5)), M.Field("b", M.IS_NOT_NULL))), ()
        elif shape == 4:
            where, order = None, (*order, M.Order("tags"))
        else:
            where = M.Field(path, r.choice([M.IS_NULL, M.IS_NOT_NULL, M.IS_NAN, M.IS_NOT_NAN]))
        cursor = M.Cursor((r.choice(VALUES),), r.random() < 0.5) if order and r.random() < 0.5 else None
        q = M.Query(DATABASE, "f", where=where, order_by=order, start=cursor if k % 2 else None, end=None if k % 2 else cursor, offset=r.choice([0, 0, 2]), limit=r.choice([None, 5, 20]), select=())
        want = answer(docs, q)
        assert [x.name for x in E.run_query(source, q).collect()] == want, q
        assert E.run_count(source, q).first()["count"] == len(want)
        nonempty += bool(want)
    assert nonempty >= 12


def test_numbers_are_exact(spark):
    ints = [V.INT_MIN, V.INT_MIN + 1, -(1 << 53) - 1, -1, 0, 1, (1 << 53) - 1, 1 << 53, (1 << 53) + 1, V.INT_MAX - 1, V.INT_MAX]
    doubles = [float(x) for x in ints] + [0.5, -0.0, math.inf, -math.inf, math.nan, 9.5, float(1 << 62)]
    a = Typed(spark.createDataFrame([(i, x) for i, x in enumerate(ints)], "id int, x long").cache(), "i", C.F.col("id"))
    b = Typed(spark.createDataFrame([(i, x) for i, x in enumerate(doubles)], "id int, x double").cache(), "d", C.F.col("id"))
    for source, stored, ops in ((a, ints, doubles), (b, doubles, ints + doubles[-4:])):
        for v in ops:
            conditions, want = [], []
            from quillon.plans.compiler import Compiler

            c = Compiler(source, M.analyse(M.Query(DATABASE, source.collection_id)))
            for op in (M.EQ, M.LT, M.LE, M.GT, M.GE, M.NE):
                conditions.append(C.F.coalesce(c.condition(M.Field("x", op, v)), C.F.lit(False)).alias(op))
                want.append([matches(M.Field("x", op, v), "", {"x": s}) for s in stored])
            rows = source.df.select("id", *conditions).orderBy("id").collect()
            for j, op in enumerate((M.EQ, M.LT, M.LE, M.GT, M.GE, M.NE)):
                assert [r[op] for r in rows] == want[j], (v, op)


def test_filters_reach_the_scan(spark, sf):
    from quillon.sources.collections import table

    q = M.Query(DATABASE, "orders", where=M.and_(M.Field("o_orderstatus", M.EQ, "F"), M.Field("o_totalprice", M.GT, 100000)), order_by=(M.Order("o_totalprice"),), limit=5, select=("o_totalprice",))
    plan = E.run_query(table(spark, sf, "orders"), q)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice,100000.0)" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1][:200]


@pytest.mark.parametrize("q", [M.Query(DATABASE, ""), M.Query(DATABASE, "x", offset=-1), M.Query(DATABASE, "x", limit=-1), M.Query(DATABASE, "x", order_by=(M.Order("a"), M.Order("`a`")))])
def test_refused(q):
    with pytest.raises(M.InvalidQuery):
        M.analyse(q)
