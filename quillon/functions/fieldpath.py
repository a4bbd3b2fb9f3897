"""Field paths: dot-separated segments, backtick quotes with backslash escapes."""

from __future__ import annotations

import re
from collections.abc import Sequence

NAME = "__name__"
_SIMPLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_QUOTED = re.compile(r"`((?:[^`\\]|\\.)*)`", re.DOTALL)
_PLAIN = re.compile(r"[^.`]+")


class FieldPathError(ValueError):
    """A field path that cannot be read."""


def parse(text: str) -> tuple[str, ...]:
    """The segments of a path. A FieldPathError for empty paths or segments, stray backticks and open quotes or escapes."""
    if not text:
        raise FieldPathError("empty field path")
    out, at = [], 0
    while True:
        quoted = text[at : at + 1] == "`"
        m = (_QUOTED if quoted else _PLAIN).match(text, at)
        if not m:
            raise FieldPathError(f"field path {text!r}: {'open quote or escape' if quoted else 'empty segment'} at {at}")
        out.append(re.sub(r"\\(.)", r"\1", m[1], flags=re.DOTALL) if quoted else m[0])
        at = m.end()
        if at == len(text):
            return tuple(out)
        if text[at] != ".":
            raise FieldPathError(f"field path {text!r}: expected a dot at {at}")
        at += 1


def render(path: Sequence[str]) -> str:
    """The canonical text of a path; ``parse`` reads it back."""
    return ".".join(s if _SIMPLE.match(s) else "`" + re.sub(r"([`\\])", r"\\\1", s) + "`" for s in path)


def get(fields: dict, path: Sequence[str]):
    """(value, True), or (None, False) where a segment is missing or no map."""
    here = fields
    for s in path:
        if not isinstance(here, dict) or s not in here:
            return None, False
        here = here[s]
    return here, True


def put(fields: dict, path: Sequence[str], value) -> None:
    """Sets a value; segments on the way that are no maps become maps."""
    for s in path[:-1]:
        if not isinstance(fields.get(s), dict):
            fields[s] = {}
        fields = fields[s]
    fields[path[-1]] = value


def drop(fields: dict, path: Sequence[str]) -> None:
    """Deletes a value; maps that become empty stay."""
    for s in path[:-1]:
        fields = fields.get(s)
        if not isinstance(fields, dict):
            return
    fields.pop(path[-1], None)


def variant_at(data, path: Sequence[str]):
    """The Column of a field within a document's tagged variant: maps stand under the tag m. Variant paths cannot name a segment
    that has quotes of both kinds; such a segment is looked up in its map."""
    from pyspark.sql import functions as F

    quote = lambda s: '["' + s + '"]' if '"' not in s else "['" + s + "']"
    steps, under = "", "$"
    for k, s in enumerate(path):
        if '"' in s and "'" in s:
            here = F.try_variant_get(data, under + steps + ".m" * (k > 0 and bool(steps)), "map<string,variant>")
            data, steps, under = F.try_element_at(here, F.lit(s)), "", "$.m"
        else:
            steps += ".m" * bool(steps) + quote(s)
    return F.try_variant_get(data, under + steps, "variant") if steps else data
