"""Queries as Columns.

Every predicate is true or not (false or null), and none is ever negated as a whole, so null acts as false. Typed fields
compare natively, on the raw column: operands are folded on the driver to what their type can hold, so filters reach
the scan and nothing is cast. Dynamic fields compare by their key struct.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import math
import operator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillon.functions import keys as K, values as V
from quillon.functions.fieldpath import NAME, FieldPathError, parse, render, variant_at
from quillon.sources.collections import Dynamic, Typed

from . import model as M

_INTS = ("tinyint", "smallint", "int", "bigint")
_FLIP = {M.LT: operator.lt, M.LE: operator.le, M.GT: operator.gt, M.GE: operator.ge}


def _false() -> Column:
    return F.lit(False)


def _true() -> Column:
    return F.lit(True)


def any_of(conditions) -> Column:
    return functools.reduce(operator.or_, conditions, _false()) if conditions else _false()


def all_of(conditions) -> Column:
    return functools.reduce(operator.and_, conditions) if conditions else _true()


def _bucket_of(kind: str) -> int:
    if kind == "boolean":
        return V.BOOLEAN
    if kind in _INTS or kind in ("float", "double"):
        return V.NUMBER
    if kind.startswith("timestamp"):
        return V.TIMESTAMP
    return {"string": V.STRING, "binary": V.BYTES}.get(kind, V.ARRAY if kind.startswith("array") else V.MAP)


class TypedField:
    """A native column seen as a field. ``null_is_value``: null columns are nulls, not missing."""

    def __init__(self, col: Column, kind: str, null_is_value: bool):
        self.col, self.kind, self.null_is_value = col, kind, null_is_value
        self.bucket, self.floating = _bucket_of(kind), kind in ("float", "double")

    @property
    def present(self) -> Column:
        return _true() if self.null_is_value else self.col.isNotNull()

    @property
    def not_null(self) -> Column:
        return self.col.isNotNull()

    def is_nan(self) -> Column:
        return self.col.isNotNull() & F.isnan(self.col) if self.floating else _false()

    def _number_range(self, op: str, v) -> Column:
        col, known = self.col, self.col.isNotNull()
        if not self.floating:
            if isinstance(v, float):
                if math.isinf(v) or not V.INT_MIN <= math.floor(v) <= V.INT_MAX:
                    return known if (v > 0) == (op in (M.LT, M.LE)) else _false()
                if v != math.floor(v):
                    v, op = (math.floor(v), M.LE) if op in (M.LT, M.LE) else (math.floor(v), M.GT)
                v = int(v)
            return _FLIP[op](col, F.lit(v))
        if isinstance(v, int) and int(float(v)) != v:
            below = int(float(v)) < v
            op = {True: {M.LT: M.LE, M.GE: M.GT}, False: {M.LE: M.LT, M.GT: M.GE}}[below].get(op, op)
        col = col.cast("double") if self.kind == "float" else col
        test = _FLIP[op](col, F.lit(float(v)))
        return test & ~F.isnan(col) if op in (M.GT, M.GE) else test

    def _moment(self, v: V.Timestamp) -> Column:
        stamp = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v.micros)
        return F.lit(stamp) if self.kind == "timestamp_ntz" else F.lit(stamp.replace(tzinfo=dt.UTC))

    def range(self, op: str, v) -> Column:
        """<, <=, >, >= within the operand's type; never NaN."""
        place = V.bucket(v)
        if place != self.bucket or place == V.NULL:
            return self.is_null_field() if place == V.NULL and op in (M.LE, M.GE) and self.null_is_value else _false()
        if place == V.NUMBER:
            return self._number_range(op, v)
        if place == V.TIMESTAMP:
            if v.nanos:
                op = {M.LT: M.LE, M.GE: M.GT}.get(op, op)
            return _FLIP[op](self.col, self._moment(v))
        if place in (V.BOOLEAN, V.STRING, V.BYTES):
            return _FLIP[op](self.col, F.lit(bytearray(v) if isinstance(v, bytes) else v))
        return _FLIP[op](K.typed_key(self.col, self.kind), K.literal_key(v))

    def is_null_field(self) -> Column:
        return self.col.isNull() if self.null_is_value else _false()

    def operand(self, v):
        """A non-null literal of the column's own type, or None where no value of the column equals ``v``."""
        if V.bucket(v) != self.bucket:
            return None
        if self.bucket == V.NUMBER:
            if self.floating:
                return F.lit(float(v)) if isinstance(v, float) or int(float(v)) == v else None
            if isinstance(v, float):
                return F.lit(int(v)) if not math.isinf(v) and v == math.floor(v) and V.INT_MIN <= v <= V.INT_MAX and int(v) <= V.INT_MAX else None
            return F.lit(v)
        if self.bucket == V.TIMESTAMP:
            return None if v.nanos else self._moment(v)
        return F.lit(bytearray(v)) if isinstance(v, bytes) else F.lit(v)

    def equals(self, v) -> Column:
        if v is None:
            return self.is_null_field()
        if V.bucket(v) == V.NAN:
            return self.is_nan()
        if self.bucket >= V.ARRAY:
            return K.typed_key(self.col, self.kind) == K.literal_key(v) if V.bucket(v) == self.bucket else _false()
        literal = self.operand(v)
        if literal is None:
            return _false()
        return (self.col.cast("double") if self.kind == "float" else self.col) == literal

    def among(self, members: list) -> Column:
        """Equal to one of the members, which are neither null nor NaN."""
        if self.bucket >= V.ARRAY:
            return any_of([self.equals(m) for m in members])
        literals = [x for x in map(self.operand, members) if x is not None]
        return (self.col.cast("double") if self.kind == "float" else self.col).isin(*literals) if literals else _false()

    def differs(self, members: list) -> Column:
        """Present, not null, and equal to none of the members; NaN members only matter where the caller passes them."""
        nan = any(V.bucket(m) == V.NAN for m in members)
        rest = [m for m in members if V.bucket(m) not in (V.NULL, V.NAN)]
        conditions = [self.not_null]
        if nan and self.floating:
            conditions.append(~F.isnan(self.col))
        same = self.among(rest)
        usable = self.bucket >= V.ARRAY or any(self.operand(m) is not None for m in rest)
        if rest and usable:
            conditions.append(~same)
        return all_of(conditions)

    def contains(self, members: list) -> Column:
        """An array with an element equal to one of the members, which are neither null nor NaN."""
        if not self.kind.startswith("array<") or not members:
            return _false()
        inner = self.kind[6:-1]
        if _bucket_of(inner) >= V.ARRAY:
            return any_of([F.exists(self.col, lambda e, m=m: F.lit(False)) for m in members])
        return F.exists(self.col, lambda e: e.isNotNull() & TypedField(e, inner, False).among(members))

    def order_terms(self) -> list[Column]:
        if self.floating:
            x = self.col.cast("double")
            return [F.when(x.isNull(), -1).when(F.isnan(x), 0).otherwise(1), x + F.lit(0.0)]
        return [K.typed_key(self.col, self.kind)] if self.bucket >= V.ARRAY else [self.col]

    def against(self, v) -> tuple[Column, Column, Column]:
        """Where the field lies by the total order: below, at or above a cursor's value. The field is present."""
        place, nan = V.bucket(v), self.is_nan()
        null = self.is_null_field()
        if place == self.bucket and place not in (V.NULL,):
            below, at, above = self.range(M.LT, v), self.equals(v), self.range(M.GT, v)
            return below | nan | null, at, above
        low = [x for x, p in ((null, V.NULL), (nan, V.NAN)) if p < place]
        same = [x for x, p in ((null, V.NULL), (nan, V.NAN)) if p == place]
        plain = self.not_null & ~F.isnan(self.col) if self.floating else self.not_null
        high = [x for x, p in ((null, V.NULL), (nan, V.NAN)) if p > place]
        (low if self.bucket < place else high).append(plain)
        return any_of(low), any_of(same), any_of(high)


class MissingField:
    """A field that no document of a typed collection has."""

    kind, bucket = "void", -1

    def __getattr__(self, name):
        if name == "order_terms":
            return list
        if name == "against":
            return lambda v: (_false(), _false(), _false())
        if name in ("present", "not_null"):
            return _false()
        return lambda *a: _false()


@F.pandas_udf(T.BooleanType())
def _nested_contains(array_json, members_json):  # type: ignore[no-untyped-def]
    def test(a, m):
        wanted = [V.sort_key(V.decode(x)) for x in json.loads(m)]
        return a is not None and any(V.sort_key(K.untagged(e)) in wanted for e in json.loads(a)["a"])

    import pandas as pd

    return pd.Series([test(a, m) for a, m in zip(array_json, members_json, strict=True)])


class DynamicField:
    """A path of a tagged variant."""

    def __init__(self, data: Column, path: str):
        self.value = variant_at(data, parse(path))
        self.place = K.dynamic_bucket(self.value)

    @property
    def present(self) -> Column:
        return self.value.isNotNull()

    @property
    def not_null(self) -> Column:
        return self.place != V.NULL

    def is_null_field(self) -> Column:
        return self.place == V.NULL

    def is_nan(self) -> Column:
        return self.place == V.NAN

    def _key(self, members: list) -> Column:
        return K.dynamic_key(self.value, any(V.bucket(m) >= V.GEOPOINT for m in members))

    def range(self, op: str, v) -> Column:
        if V.bucket(v) == V.NAN:
            return _false()
        return (self.place == V.bucket(v)) & _FLIP[op](self._key([v]), K.literal_key(v))

    def equals(self, v) -> Column:
        return self._key([v]) == K.literal_key(v)

    def among(self, members: list) -> Column:
        return self._key(members).isin(*map(K.literal_key, members)) if members else _false()

    def differs(self, members: list) -> Column:
        return self.not_null & ~self._key(members).isin(*map(K.literal_key, members)) if members else self.not_null

    def contains(self, members: list) -> Column:
        if not members:
            return _false()
        if any(V.bucket(m) >= V.GEOPOINT for m in members):
            listed = F.when(self.place == V.ARRAY, F.to_json(self.value))
            return _nested_contains(listed, F.lit(json.dumps([V.encode(m) for m in members])))
        literals = [K.literal_key(m) for m in members]
        return F.exists(K.payload(self.value, "a", "array<variant>"), lambda e: K.dynamic_key(e, False).isin(*literals))

    def order_terms(self) -> list[Column]:
        return [K.dynamic_key(self.value, True)]

    def against(self, v) -> tuple[Column, Column, Column]:
        key, literal = K.dynamic_key(self.value, V.bucket(v) >= V.GEOPOINT), K.literal_key(v)
        return key < literal, key == literal, key > literal


class NameField:
    """The document's name: a reference to itself. In one collection ids order as names do, and cheaper."""

    def __init__(self, source, q: M.Query):
        self.name, self.prefix = source.name, None if q.all_descendants else f"{q.parent}/{q.collection_id}/"
        self.doc_id = source.doc_id.cast("string") if isinstance(source, Typed) else F.col("doc_id")

    present = property(lambda self: _true())
    not_null = present

    def is_null_field(self) -> Column:
        return _false()

    is_nan = is_null_field

    def _sides(self, v):
        """(column, literal) that compare as the names do; None for operands that are no reference."""
        if not isinstance(v, V.Ref):
            return None
        if self.prefix and v.path.startswith(self.prefix) and "/" not in v.path[len(self.prefix) :]:
            return self.doc_id, F.lit(v.path[len(self.prefix) :])
        return K.name_bytes(self.name), F.lit(bytearray(v.path.replace("/", "\0").encode("utf-8", "surrogatepass")))

    def range(self, op: str, v) -> Column:
        sides = self._sides(v)
        return _FLIP[op](*sides) if sides else _false()

    def equals(self, v) -> Column:
        sides = self._sides(v)
        return sides[0] == sides[1] if sides else _false()

    def among(self, members: list) -> Column:
        inside = [s for s in map(self._sides, members) if s]
        if inside and self.prefix and all(isinstance(m, V.Ref) and m.path.startswith(self.prefix) for m in members):
            return self.name.isin([m.path for m in members])
        return any_of([a == b for a, b in inside])

    def differs(self, members: list) -> Column:
        same = [s for s in map(self._sides, members) if s]
        return all_of([a != b for a, b in same])

    def contains(self, members: list) -> Column:
        return _false()

    def order_terms(self) -> list[Column]:
        return [self.doc_id] if self.prefix else [F.split(self.name, "/")]

    def against(self, v) -> tuple[Column, Column, Column]:
        sides = self._sides(v)
        if not sides:
            return (_true(), _false(), _false()) if V.bucket(v) > V.REFERENCE else (_false(), _false(), _true())
        return sides[0] < sides[1], sides[0] == sides[1], sides[0] > sides[1]


class Compiler:
    def __init__(self, source: Typed | Dynamic, query: M.Query):
        self.source, self.q = source, query

    def field(self, path: str):
        """The field at a path, or None where the path cannot be read."""
        if path == NAME:
            return NameField(self.source, self.q)
        try:
            path = render(parse(path))
        except FieldPathError:
            return None
        if isinstance(self.source, Dynamic):
            return DynamicField(F.col("_data"), path)
        found = self.source.column(path)
        return TypedField(*found, self.source.null_means == "null") if found else MissingField()

    def condition(self, f) -> Column:
        if f is None:
            return _true()
        if isinstance(f, M.Composite):
            parts = [self.condition(x) for x in f.filters]
            return (all_of(parts) if f.op == M.AND else any_of(parts)) if f.op in (M.AND, M.OR) else _false()
        x, v = self.field(f.path), f.value
        if x is None:
            return _false()
        dull = lambda m: V.bucket(m) in (V.NULL, V.NAN)
        if f.op == M.EQ:
            return x.equals(v)
        if f.op == M.NE:
            return x.differs([v] if not (v is None) else [])
        if f.op in _FLIP:
            return _false() if V.bucket(v) == V.NAN else x.range(f.op, v)
        if f.op == M.IN:
            return x.among([m for m in v if not dull(m)]) if isinstance(v, (list, tuple)) else _false()
        if f.op == M.NOT_IN:
            if not isinstance(v, (list, tuple)) or any(m is None for m in v):
                return _false()
            return x.differs([m for m in v if not dull(m)])
        if f.op == M.CONTAINS:
            return _false() if dull(v) else x.contains([v])
        if f.op == M.CONTAINS_ANY:
            return x.contains([m for m in v if not dull(m)]) if isinstance(v, (list, tuple)) else _false()
        if f.op == M.IS_NULL:
            return x.is_null_field()
        if f.op == M.IS_NOT_NULL:
            return x.present & x.not_null
        if f.op == M.IS_NAN:
            return x.is_nan()
        if f.op == M.IS_NOT_NAN:
            return x.differs([math.nan])
        return _false()

    def in_range(self, c: M.Cursor, after: bool) -> Column:
        """Rows on the cursor's far side (after) or near side, by the first terms of the ordering."""
        inclusive = c.before if after else not c.before
        conditions, same = [], []
        for o, v in zip(self.q.order_by, c.values, strict=False):
            below, at, above = self.field(o.path).against(v)
            beyond = above if after == (o.direction == M.ASC) else below
            conditions.append(all_of([*same, beyond]))
            same.append(at)
        if inclusive:
            conditions.append(all_of(same))
        return any_of(conditions)

    def matching(self) -> DataFrame:
        """Documents that the filters, the ordering's presence rule and the cursors let through."""
        df = self.source.scan(self.q.parent, self.q.all_descendants)
        if isinstance(self.source, Dynamic):
            df = df.withColumn("_data", F.parse_json("data"))
        if self.q.where is not None:
            df = df.filter(self.condition(self.q.where))
        for o in self.q.order_by:
            field = self.field(o.path)
            if field is None:
                return df.filter(_false())
            if o.path != NAME:
                df = df.filter(field.present)
        for cursor, after in ((self.q.start, True), (self.q.end, False)):
            if cursor is not None and cursor.values:
                df = df.filter(self.in_range(cursor, after))
        return df

    def ordering(self) -> list[Column]:
        terms = []
        for o in self.q.order_by:
            for t in self.field(o.path).order_terms():
                terms.append(t.asc_nulls_first() if o.direction == M.ASC else t.desc_nulls_last())
        return terms

    def paged(self, df: DataFrame) -> DataFrame:
        """Sorted, with offset and limit. Spark keeps only the first offset + limit rows of each task."""
        df = df.orderBy(*self.ordering())
        if self.q.offset:
            df = df.offset(self.q.offset)
        return df if self.q.limit is None else df.limit(self.q.limit)

    def projected(self, df: DataFrame) -> DataFrame:
        """The name and the selected fields; fields that a typed schema lacks are left out."""
        name = self.source.name.alias("name")
        if self.q.select is not None:
            paths = [render(parse(p)) for p in self.q.select if p != NAME]
        if isinstance(self.source, Dynamic):
            if self.q.select is None:
                return df.drop("_data")
            wanted = json.dumps([list(parse(p)) for p in paths])
            return df.select(name, _project(F.col("data"), F.lit(wanted)).alias("data") if paths else F.lit("{}").alias("data"))
        if self.q.select is None:
            paths = self.source.fields()
        found = [(p, self.source.column(p)) for p in dict.fromkeys(paths)]
        return df.select(name, *[c[0].alias(parse(p)[0] if len(parse(p)) == 1 else p) for p, c in found if c])


@F.pandas_udf(T.StringType())
def _project(data, paths):  # type: ignore[no-untyped-def]
    from quillon.functions import fieldpath as P

    def one(text, wanted):
        out: dict = {}
        tree = {"m": json.loads(text)}
        for path in json.loads(wanted):
            here = tree
            for s in path:
                here = here.get("m", {}).get(s) if isinstance(here, dict) and "m" in here else None
            if here is not None:
                P.put(out, [x for s in path for x in (s, "m")][:-1], here)
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    import pandas as pd

    return pd.Series([one(a, b) for a, b in zip(data, paths, strict=True)])
