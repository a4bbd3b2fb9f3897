"""Writes to documents: sets, merges, deletes, field transforms and preconditions.

``apply_write`` is pure: state and write in, state and results out. ``fold_writes`` applies a table of writes to a table of
documents, each document's writes in order, one task per group of names. ``transform_columns`` are the transforms of a
bulk update on native columns.
"""

from __future__ import annotations

import copy
import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions import fieldpath as P, values as V

SERVER_TIME, INCREMENT, MAXIMUM, MINIMUM, ARRAY_UNION, ARRAY_REMOVE = "server-time", "increment", "maximum", "minimum", "array-union", "array-remove"


class WriteError(ValueError):
    """A write that fails; ``code`` says how."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Transform:
    path: str
    kind: str
    operand: Any = None


@dataclass(frozen=True)
class Write:
    """``op``: set, delete or transform. ``mask``: None sets all fields; else only these paths are set, or dropped where absent."""

    name: str
    op: str = "set"
    fields: dict = field(default_factory=dict)
    mask: tuple[str, ...] | None = None
    transforms: tuple[Transform, ...] = ()
    exists: bool | None = None
    update_time: V.Timestamp | None = None


@dataclass
class State:
    """A document as it is: fields None where it does not exist."""

    fields: dict | None = None
    create_time: V.Timestamp | None = None
    update_time: V.Timestamp | None = None


def check(state: State, w: Write) -> None:
    there = state.fields is not None
    if w.exists is True and not there:
        raise WriteError("NOT_FOUND", f"no document {w.name}")
    if w.exists is False and there:
        raise WriteError("ALREADY_EXISTS", f"document {w.name} exists")
    if w.update_time is not None and (not there or state.update_time.micros != w.update_time.micros):
        raise WriteError("FAILED_PRECONDITION", f"document {w.name} has another update time")


def _numeric(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def increment(current, operand):
    """Integers saturate; a double on either side makes a double; anything but a number gives way to the operand."""
    if not _numeric(operand) or not _numeric(current):
        return operand
    if isinstance(current, int) and isinstance(operand, int):
        return max(V.INT_MIN, min(V.INT_MAX, current + operand))
    return float(current) + float(operand)


def extremum(current, operand, sign: int):
    """The larger (1) or smaller (-1) number; NaN wins, ties keep the stored value, non-numbers give way."""
    if not _numeric(current):
        return operand
    if any(isinstance(x, float) and math.isnan(x) for x in (current, operand)):
        return math.nan
    return operand if V.compare(operand, current) * sign > 0 else current


def array_union(current, operand: list) -> list:
    out = list(current) if isinstance(current, list) else []
    for x in operand:
        if not any(V.equal(x, y) for y in out):
            out.append(x)
    return out


def array_remove(current, operand: list) -> list:
    return [x for x in current if not any(V.equal(x, y) for y in operand)] if isinstance(current, list) else []


def apply_write(state: State, w: Write, now: V.Timestamp) -> tuple[State, list]:
    """The document after a write, and its transforms' results (null for the array transforms)."""
    if not w.name:
        raise WriteError("INVALID_ARGUMENT", "a write without a document")
    if w.op not in ("set", "delete", "transform"):
        raise WriteError("INVALID_ARGUMENT", f"unknown write {w.op!r}")
    check(state, w)
    if w.op == "delete":
        if w.transforms:
            raise WriteError("INVALID_ARGUMENT", "a delete takes no transforms")
        return State(), []
    if w.op == "transform":
        fields = copy.deepcopy(state.fields) or {}
    elif w.mask is None:
        fields = copy.deepcopy(w.fields)
    else:
        fields = copy.deepcopy(state.fields) or {}
        for path in map(P.parse, w.mask):
            value, there = P.get(w.fields, path)
            if there:
                P.put(fields, path, copy.deepcopy(value))
            else:
                P.drop(fields, path)
    results = []
    for t in w.transforms:
        path = P.parse(t.path)
        current, _ = P.get(fields, path)
        if t.kind == SERVER_TIME:
            value = now
        elif t.kind == INCREMENT:
            value = increment(current, t.operand)
        elif t.kind in (MAXIMUM, MINIMUM):
            value = extremum(current, t.operand, 1 if t.kind == MAXIMUM else -1)
        elif t.kind == ARRAY_UNION:
            value = array_union(current, t.operand)
        elif t.kind == ARRAY_REMOVE:
            value = array_remove(current, t.operand)
        else:
            raise WriteError("INVALID_ARGUMENT", f"unknown transform {t.kind!r}")
        P.put(fields, path, value)
        results.append(None if t.kind in (ARRAY_UNION, ARRAY_REMOVE) else value)
    return State(fields, state.create_time or now, now), results


# ---- a table of writes ----


def dump_write(w: Write) -> str:
    out: dict = {"name": w.name, "op": w.op, "fields": V.encode_fields(w.fields), "mask": w.mask and list(w.mask) if w.mask else w.mask, "exists": w.exists}
    out["transforms"] = [[t.path, t.kind, V.encode(t.operand)] for t in w.transforms]
    out["update_time"] = w.update_time and w.update_time.micros
    return json.dumps(out)


def load_write(text: str) -> Write:
    o = json.loads(text)
    transforms = tuple(Transform(p, k, V.decode(x)) for p, k, x in o["transforms"])
    moment = None if o["update_time"] is None else V.Timestamp(o["update_time"])
    return Write(o["name"], o["op"], V.decode_fields(o["fields"]), None if o["mask"] is None else tuple(o["mask"]), transforms, o["exists"], moment)


FOLDED = "name string, data string, create_us long, update_us long, changed boolean, results string, error string"


def fold_writes(documents: DataFrame, writes: DataFrame, now: V.Timestamp) -> DataFrame:
    """Documents (name, data, create_us, update_us) after writes (seq, name, write): one row per name that is written.

    A row has the new fields (null once deleted), whether it changed, the writes' results by seq, or the first error.
    """

    def fold(key, docs, todo):
        import pandas as pd

        name, state = key[0], State()
        if len(docs):
            d = docs.iloc[0]
            state = State(V.loads(d["data"]), V.Timestamp(int(d["create_us"])), V.Timestamp(int(d["update_us"])))
        before, results, error = state.fields, {}, None
        if not len(todo):
            return pd.DataFrame({c.split(" ")[0]: [] for c in FOLDED.split(", ")})
        for seq, text in sorted(zip(todo["seq"], todo["write"], strict=True)):
            try:
                state, got = apply_write(state, load_write(text), now)
                results[int(seq)] = [V.encode(x) for x in got]
            except (WriteError, P.FieldPathError) as e:
                error = f"{getattr(e, 'code', 'INVALID_ARGUMENT')}: {seq}: {e}"
                break
        alive = state.fields is not None
        row = [name, V.dumps(state.fields) if alive else None, state.create_time.micros if alive else None, state.update_time.micros if alive else None, alive or before is not None, json.dumps(results), error]
        return pd.DataFrame([row], columns=[c.split(" ")[0] for c in FOLDED.split(", ")])

    left = documents.select("name", "data", "create_us", "update_us").groupBy("name")
    return left.cogroup(writes.select("seq", "name", "write").groupBy("name")).applyInPandas(fold, FOLDED)


# ---- transforms of native columns ----


def increment_column(col: Column, operand: int | float, integral: bool) -> Column:
    """As ``increment``, for a column that may be null."""
    if integral and isinstance(operand, int):
        edge = F.lit(V.INT_MAX if operand > 0 else V.INT_MIN)
        return F.when(col.isNull(), F.lit(operand)).otherwise(F.coalesce(F.try_add(col.cast("long"), F.lit(operand)), edge))
    return F.coalesce(col.cast("double") + F.lit(float(operand)), F.lit(float(operand)))


def extremum_column(col: Column, operand: int | float, sign: int) -> Column:
    other = F.lit(operand)
    better = other > col if sign > 0 else other < col
    is_nan = F.isnan(col.cast("double"))
    return F.when(col.isNull(), other).when(is_nan, col).when(better, other).otherwise(col)


def array_union_column(col: Column, operand: list) -> Column:
    """Appends elements that are not there yet; duplicates that are stored stay."""
    new = F.array_distinct(F.array(*map(F.lit, operand)))
    return F.when(col.isNull(), new).otherwise(F.concat(col, F.filter(new, lambda x: ~F.exists(col, lambda y: y.eqNullSafe(x)))))


def array_remove_column(col: Column, operand: list) -> Column:
    """Drops every element equal to one of the operand's; other duplicates stay."""
    gone = F.array(*map(F.lit, operand))
    return F.coalesce(F.filter(col, lambda y: ~F.exists(gone, lambda x: x.eqNullSafe(y))), F.filter(gone, lambda x: F.lit(False)))


def merge_columns(df: DataFrame, on: str, updates: DataFrame, mask: list[str]) -> DataFrame:
    """Typed merge: for ids in ``updates`` the masked columns are set, or null where the update has null; others stay."""
    u = updates.select(F.col(on).alias("_on"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in mask])
    joined = df.join(u, df[on] == u["_on"], "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in mask else F.col(c) for c in df.columns])
