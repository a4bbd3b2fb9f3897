"""Order keys as Columns: struct<t, d, r, b>, whose natural order is the total order of values.

t: the type's place. d: numbers as doubles. r: what a 64-bit integer has beyond its double; booleans; microseconds.
b: bytes of strings, binaries, names and, by an Arrow function, of nested values. Parts that a type does not use are
constant, so structs of equal values are equal. Everything but nested values stays in generated code.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F, types as T

from . import values as V



def _key(t, d=None, r=None, b=None) -> Column:
    return F.struct(
        (t if isinstance(t, Column) else F.lit(t)).cast("int").alias("t"),
        (F.lit(0.0) if d is None else d).cast("double").alias("d"),
        (F.lit(0) if r is None else r).cast("long").alias("r"),
        (F.lit(bytearray()) if b is None else b).cast("binary").alias("b"),
    )


def int_parts(x: Column) -> tuple[Column, Column]:
    """The double next to a 64-bit integer, and the exact rest."""
    d = x.cast("double")
    rest = F.when(d >= 9.223372036854775807e18, x - F.lit(V.INT_MAX) - F.lit(1)).otherwise(x - F.least(d, F.lit(9.2233720368547748e18)).cast("long"))
    return d, rest


def name_bytes(name: Column) -> Column:
    """Bytes that order names by segment: the separator sorts before every character, and names have no NUL."""
    return F.encode(F.replace(name, F.lit("/"), F.lit("\0")), "UTF-8")


def typed_key(col: Column, kind: str) -> Column:
    """The key of a native column; null where the column is null. ``kind``: a Spark type name, or ref."""
    if kind == "boolean":
        key = _key(V.BOOLEAN, r=col.cast("int"))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        d, r = int_parts(col.cast("long"))
        key = _key(V.NUMBER, d, r)
    elif kind in ("float", "double"):
        x = col.cast("double")
        key = _key(F.when(F.isnan(x), V.NAN).otherwise(V.NUMBER), F.when(F.isnan(x), 0.0).otherwise(x + F.lit(0.0)))
    elif kind in ("timestamp", "timestamp_ntz"):
        key = _key(V.TIMESTAMP, r=F.unix_micros(col.cast("timestamp")))
    elif kind == "string":
        key = _key(V.STRING, b=F.encode(col, "UTF-8"))
    elif kind == "binary":
        key = _key(V.BYTES, b=col)
    elif kind == "ref":
        key = _key(V.REFERENCE, b=name_bytes(col))
    else:
        key = _key(V.ARRAY if kind.startswith("array") else V.MAP, b=nested_bytes(F.to_json(tagged(col, kind))))
    return F.when(col.isNotNull(), key)


def literal_key(v) -> Column:
    """The key of a value known on the driver. Sub-microsecond timestamps fall between stored ones."""
    place = V.bucket(v)
    if place == V.BOOLEAN:
        return _key(place, r=F.lit(int(v)))
    if place == V.NUMBER:
        d = float(v)
        rest = int(v) - int(d) if isinstance(v, int) and not isinstance(v, bool) else 0
        return _key(place, F.lit(d + 0.0), F.lit(rest))
    if place == V.TIMESTAMP:
        # r holds whole microseconds; d splits what lies between two of them
        return _key(place, F.lit(0.0), F.lit(v.micros), F.lit(bytearray([1]) if v.nanos else bytearray()))
    if place == V.STRING:
        return _key(place, b=F.lit(bytearray(v.encode("utf-8", "surrogatepass"))))
    if place == V.BYTES:
        return _key(place, b=F.lit(bytearray(v)))
    if place == V.REFERENCE:
        return _key(place, b=F.lit(bytearray(v.path.replace("/", "\0").encode("utf-8", "surrogatepass"))))
    if place in (V.NULL, V.NAN):
        return _key(place)
    return _key(place, b=F.lit(bytearray(V.sort_key(v))))


def untagged(x):
    """The value of a tagged form in which a value without a tag is null."""
    if not x:
        return None
    if "a" in x:
        return [untagged(e) for e in x["a"]]
    if "m" in x:
        return {k: untagged(e) for k, e in x["m"].items()}
    return V.decode(x)


@F.pandas_udf(T.BinaryType())
def nested_bytes(tagged_json):  # type: ignore[no-untyped-def]
    """Key bytes of nested values from their tagged JSON; null for null."""
    return tagged_json.map(lambda s: None if s is None else V.sort_key(untagged(json.loads(s))))


def tagged(col: Column, kind: str | T.DataType) -> Column:
    """A native column as a tagged struct, for nested keys; JSON leaves the tag of a null away."""
    kind = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.ArrayType):
        return F.struct(F.transform(col, lambda e: tagged(e, kind.elementType)).alias("a"))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.struct(F.transform_values(col, lambda _, e: tagged(e, kind.valueType)).alias("m"))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[tagged(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.struct(F.when(col.isNotNull(), inner).alias("m"))
    if isinstance(kind, T.StringType):
        return F.struct(col.alias("s"))
    if isinstance(kind, T.BooleanType):
        return F.struct(col.alias("b"))
    if isinstance(kind, T.BinaryType):
        return F.struct(F.base64(col).alias("y"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.struct(col.cast("string").alias("i"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.struct(col.cast("double").cast("string").alias("d"))
    raise V.BadValue(f"no nested form of {kind.simpleString()}")


# ---- dynamic values: tagged variants ----


def payload(v: Column, tag: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{tag}", kind)


def dynamic_bucket(v: Column) -> Column:
    """The place of a tagged variant's type; null where the value is missing."""
    d = payload(v, "d", "string")
    vector = (payload(v, 'm["__type__"].s', "string") == "__vector__") & payload(v, "m.value", "variant").isNotNull()
    return (
        F.when(payload(v, "i", "string").isNotNull(), V.NUMBER)
        .when(d.isNotNull(), F.when(F.lower(d) == "nan", V.NAN).otherwise(V.NUMBER))
        .when(payload(v, "s", "string").isNotNull() | payload(v, "s0", "string").isNotNull(), V.STRING)
        .when(payload(v, "b", "boolean").isNotNull(), V.BOOLEAN)
        .when(payload(v, "t", "string").isNotNull(), V.TIMESTAMP)
        .when(payload(v, "y", "string").isNotNull(), V.BYTES)
        .when(payload(v, "r", "string").isNotNull(), V.REFERENCE)
        .when(payload(v, "g", "variant").isNotNull(), V.GEOPOINT)
        .when(payload(v, "a", "variant").isNotNull(), V.ARRAY)
        .when(payload(v, "m", "variant").isNotNull(), F.when(vector, V.VECTOR).otherwise(V.MAP))
        .when(payload(v, "z", "variant").isNotNull(), V.NULL)
    )


def dynamic_key(v: Column, nested: bool) -> Column:
    """The key of a tagged variant; null where missing. ``nested``: also bytes of arrays, maps, vectors and geopoints."""
    t = dynamic_bucket(v)
    i = payload(v, "i", "string").try_cast("long")
    d = F.regexp_replace(payload(v, "d", "string"), r"^\+", "").try_cast("double")
    di, ri = int_parts(i)
    micros = F.unix_micros(payload(v, "t", "string").try_cast("timestamp"))
    text = F.encode(payload(v, "s", "string"), "UTF-8")
    # a value has one tag, so at most one of these is not null
    parts = [text, F.unbase64(payload(v, "s0", "string")), F.unbase64(payload(v, "y", "string")), name_bytes(payload(v, "r", "string"))]
    if nested:
        parts.append(nested_bytes(F.when(F.coalesce(payload(v, "g", "variant"), payload(v, "a", "variant"), payload(v, "m", "variant")).isNotNull(), F.to_json(v))))
    number = F.coalesce(di, F.when(F.isnan(d), 0.0).otherwise(d + F.lit(0.0)), F.lit(0.0))
    rest = F.coalesce(ri, micros, payload(v, "b", "boolean").cast("int").cast("long"), F.lit(0).cast("long"))
    key = _key(t, number, rest, F.coalesce(*parts, F.lit(bytearray())))
    return F.when(v.isNotNull(), key)
