"""The structured query: one collection, filters, ordering, cursors, offset, limit, projection."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field, replace
from typing import Any

from quillon.functions.fieldpath import NAME, parse, render
from quillon.functions.values import Geo, Ref, parse_timestamp

EQ, NE, LT, LE, GT, GE, IN, NOT_IN, CONTAINS, CONTAINS_ANY = "==", "!=", "<", "<=", ">", ">=", "in", "not-in", "array-contains", "array-contains-any"
IS_NULL, IS_NOT_NULL, IS_NAN, IS_NOT_NAN = "is-null", "is-not-null", "is-nan", "is-not-nan"
AND, OR, ASC, DESC = "and", "or", "asc", "desc"


class InvalidQuery(ValueError):
    """A query that the engine refuses."""


@dataclass(frozen=True)
class Field:
    path: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Composite:
    op: str
    filters: tuple = ()


@dataclass(frozen=True)
class Order:
    path: str
    direction: str = ASC


@dataclass(frozen=True)
class Cursor:
    """Values for the first order terms. ``before``: the position just before rows that equal them."""

    values: tuple
    before: bool


@dataclass(frozen=True)
class Query:
    parent: str
    collection_id: str
    all_descendants: bool = False
    where: Any = None
    order_by: tuple[Order, ...] = ()
    start: Cursor | None = None
    end: Cursor | None = None
    offset: int = 0
    limit: int | None = None
    #: None: whole documents; an empty tuple or only the name: names alone.
    select: tuple[str, ...] | None = None


def and_(*filters) -> Composite:
    return Composite(AND, filters)


def or_(*filters) -> Composite:
    return Composite(OR, filters)


def start_at(*values) -> Cursor:
    return Cursor(values, True)


def start_after(*values) -> Cursor:
    return Cursor(values, False)


def end_before(*values) -> Cursor:
    return Cursor(values, True)


def end_at(*values) -> Cursor:
    return Cursor(values, False)


# Names of the operators in queries that come as JSON.
_OPS = {
    "EQUAL": EQ, "NOT_EQUAL": NE, "LESS_THAN": LT, "LESS_THAN_OR_EQUAL": LE, "GREATER_THAN": GT, "GREATER_THAN_OR_EQUAL": GE,
    "IN": IN, "NOT_IN": NOT_IN, "ARRAY_CONTAINS": CONTAINS, "ARRAY_CONTAINS_ANY": CONTAINS_ANY,
}
_UNARY = {"IS_NULL": IS_NULL, "IS_NOT_NULL": IS_NOT_NULL, "IS_NAN": IS_NAN, "IS_NOT_NAN": IS_NOT_NAN}


def value_from_json(v: dict) -> Any:
    """A value of a query that comes as JSON: {"integerValue": "5"} and the like."""
    ((kind, x),) = v.items()
    if kind == "nullValue":
        return None
    if kind == "integerValue":
        return int(x)
    if kind == "doubleValue":
        return float(x)
    if kind in ("booleanValue", "stringValue"):
        return x
    if kind == "timestampValue":
        return parse_timestamp(x)
    if kind == "bytesValue":
        return base64.b64decode(x)
    if kind == "referenceValue":
        return Ref(x)
    if kind == "geoPointValue":
        return Geo(float(x.get("latitude", 0)), float(x.get("longitude", 0)))
    if kind == "arrayValue":
        return [value_from_json(e) for e in x.get("values", [])]
    if kind == "mapValue":
        return {k: value_from_json(e) for k, e in x.get("fields", {}).items()}
    raise InvalidQuery(f"unknown value kind {kind}")


def _filter_from_json(f: dict):
    if "compositeFilter" in f:
        c = f["compositeFilter"]
        if c.get("op") not in ("AND", "OR"):
            raise InvalidQuery(f"unknown composite operator {c.get('op')!r}")
        return Composite(c["op"].lower(), tuple(map(_filter_from_json, c.get("filters", []))))
    if "unaryFilter" in f:
        u = f["unaryFilter"]
        return Field(u["field"]["fieldPath"], _UNARY.get(u.get("op"), u.get("op", "")))
    if "fieldFilter" in f:
        x = f["fieldFilter"]
        return Field(x["field"]["fieldPath"], _OPS.get(x.get("op"), x.get("op", "")), value_from_json(x["value"]))
    return Composite(AND) if not f else Field("", "unknown")


def query_from_json(parent: str, q: dict) -> Query:
    """A structured query from its JSON form."""
    source = q.get("from", [])
    if len(source) != 1 or not source[0].get("collectionId"):
        raise InvalidQuery("a query has exactly one collection")
    cursor = lambda c: Cursor(tuple(map(value_from_json, c.get("values", []))), bool(c.get("before"))) if c else None
    limit = q.get("limit")
    limit = limit.get("value") if isinstance(limit, dict) else limit
    return Query(
        parent,
        source[0]["collectionId"],
        bool(source[0].get("allDescendants")),
        _filter_from_json(q["where"]) if q.get("where") else None,
        tuple(Order(o["field"]["fieldPath"], DESC if o.get("direction") == "DESCENDING" else ASC) for o in q.get("orderBy", [])),
        cursor(q.get("startAt")),
        cursor(q.get("endAt")),
        int(q.get("offset", 0)),
        None if limit is None else int(limit),
        tuple(f["fieldPath"] for f in q["select"].get("fields", [])) if q.get("select") is not None else None,
    )


# ---- analysis ----

_INEQUALITIES = frozenset([LT, LE, GT, GE, NE, NOT_IN, IS_NOT_NULL, IS_NOT_NAN])


def walk(f):
    """All field filters, parents before children."""
    if isinstance(f, Composite):
        for x in f.filters:
            yield from walk(x)
    elif f is not None:
        yield f


def _canonical(path: str) -> str:
    return path if path == NAME else render(parse(path))


def _name_value(q: Query, v):
    """A string operand for the name becomes a reference to the document: relative to the collection, or to the parent of a group."""
    if not isinstance(v, str):
        return v
    if v.startswith("projects/"):
        return Ref(v)
    return Ref(f"{q.parent}/{v}" if q.all_descendants else f"{q.parent}/{q.collection_id}/{v}")


def _resolve(q: Query, f):
    if isinstance(f, Composite):
        return Composite(f.op, tuple(_resolve(q, x) for x in f.filters))
    if isinstance(f, Field) and f.path == NAME:
        value = [_name_value(q, x) for x in f.value] if isinstance(f.value, (list, tuple)) else _name_value(q, f.value)
        return Field(f.path, f.op, value)
    return f


def analyse(q: Query) -> Query:
    """Checks a query, resolves names and makes the ordering explicit.

    The ordering is the explicit terms, else the first inequality field ascending; then the name, in the last term's
    direction, unless it is there. A prefix of the ordering's values may stand in a cursor; more are ignored.
    """
    if not q.collection_id:
        raise InvalidQuery("a query has exactly one collection")
    if q.offset < 0 or (q.limit is not None and q.limit < 0):
        raise InvalidQuery("offset and limit must not be negative")
    order = [Order(_canonical(o.path), o.direction) for o in q.order_by]
    if len({o.path for o in order}) < len(order):
        raise InvalidQuery("a field stands twice in the ordering")
    if any(o.direction not in (ASC, DESC) for o in order):
        raise InvalidQuery("a direction is asc or desc")
    if not order:
        first = next((f.path for f in walk(q.where) if f.op in _INEQUALITIES), None)
        if first and first != NAME:
            order.append(Order(_canonical(first)))
    if all(o.path != NAME for o in order):
        order.append(Order(NAME, order[-1].direction if order else ASC))

    def cursor(c: Cursor | None) -> Cursor | None:
        return c and Cursor(tuple(_name_value(q, v) if o.path == NAME else v for o, v in zip(order, c.values, strict=False)), c.before)

    return replace(q, where=_resolve(q, q.where), order_by=tuple(order), start=cursor(q.start), end=cursor(q.end))


def reversed_order(q: Query) -> Query:
    """For the last rows of a query: all directions turned, cursors swapped. Rows come in falling order."""
    a = analyse(q)
    turn = tuple(Order(o.path, DESC if o.direction == ASC else ASC) for o in a.order_by)
    return replace(a, order_by=turn, start=a.end and Cursor(a.end.values, not a.end.before), end=a.start and Cursor(a.start.values, not a.start.before))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Any", "field")]
