"""Values, their order, byte keys and codec, against each other; field paths."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st

from quillon.functions import fieldpath as P, values as V

POOL = [
    None, False, True, math.nan, -math.inf, math.inf, -1, 0, -0.0, 0.0, 0.5, 1, 2, (1 << 53) + 1, float(1 << 53), V.INT_MIN, V.INT_MAX, float(1 << 63), 5e-324, -5e-324, 1e300,
    V.Timestamp(1), V.Timestamp(-5), "", "a", "b", "ab", "Z", "é", "日本", "\0", "￿", "\U0010ffff", b"", b"\0", b"\1\2", V.Ref("a"), V.Ref("a/b"), V.Ref("a!x"),
    V.Geo(1.0, 2.0), V.Geo(1.0, 3.0), [], [1], [1, "x"], {}, {"k": 1}, {"__type__": "__vector__", "value": [1.0]}, {"__type__": "__vector__", "value": [1.0, 0.0]},
]


def test_byte_keys_order_as_compare():
    for a in POOL:
        for b in POOL:
            ka, kb = V.sort_key(a), V.sort_key(b)
            assert (ka > kb) - (ka < kb) == V.compare(a, b), (a, b)
            da, db = V.descending(ka), V.descending(kb)
            assert (da > db) - (da < db) == -V.compare(a, b)


def test_key_bytes():
    want = {1: "280304328000000000000000", -1: "2801fbcd7fffffffffffffff", "a": "38610001", b"\0": "4000ff0001", 0.0: "2802", math.inf: "2804"}
    for v, h in want.items():
        assert V.sort_key(v).hex() == h
    assert V.sort_key([]).hex() == "5800" and V.sort_key({}).hex() == "6000" and V.sort_key(True).hex() == "1801"


scalars = st.one_of(st.none(), st.booleans(), st.integers(V.INT_MIN, V.INT_MAX), st.floats(), st.text(max_size=5), st.binary(max_size=5))
values = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3).filter(lambda s: "\0" not in s), x, max_size=3)), max_leaves=6)


@settings(max_examples=400, deadline=None)
@given(values, values)
def test_random_keys_order_as_compare(a, b):
    ka, kb = V.sort_key(a), V.sort_key(b)
    assert (ka > kb) - (ka < kb) == V.compare(a, b)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(max_size=3).filter(lambda s: "\0" not in s), values, max_size=4))
def test_codec_round_trip(fields):
    try:
        text = V.dumps(fields)
    except UnicodeEncodeError:
        return
    assert V.equal(V.loads(text), fields)


@pytest.mark.parametrize("bad", [{}, {"i": "1", "d": "2"}, {"q": 1}, {"i": "x"}, {"i": str(1 << 64)}, {"d": "1_0"}, {"t": "no"}, {"b": "true"}, {"g": ["1"]}, {"y": "?"}, 5])
def test_codec_refuses(bad):
    with pytest.raises(V.BadValue):
        V.decode(bad)


def test_names():
    names = ["a!x", "a/b", "a", "a/b/c", "b"]
    assert sorted(names, key=V.name_key) == ["a", "a/b", "a/b/c", "a!x", "b"]
    random.shuffle(names)
    d = V.document_name("projects/p/databases/d/documents/c/x/s/y")
    assert (d.parent_path, d.collection_id, d.doc_id) == ("projects/p/databases/d/documents/c/x", "s", "y")
    for bad in ("", "a/b", "projects/p/databases/d/documents/c", "projects/p/databases/d/documents/c//"):
        with pytest.raises(V.BadName):
            V.document_name(bad)


def test_paths():
    for text, path in (("a", ("a",)), ("a.b", ("a", "b")), ("`a.b`.c", ("a.b", "c")), ("`x\\`y`", ("x`y",))):
        assert P.parse(text) == path and P.parse(P.render(path)) == path
    for bad in ("", ".", "a.", ".a", "a..b", "`a", "a`b", "`a`b", "`a\\"):
        with pytest.raises(P.FieldPathError):
            P.parse(bad)
    d = {"a": {"b": 1}, "c": 2}
    assert P.get(d, ("a", "b")) == (1, True) and P.get(d, ("c", "b")) == (None, False)
    P.put(d, ("c", "x"), 3)
    P.drop(d, ("a", "b"))
    assert d == {"a": {}, "c": {"x": 3}}


def test_sizes():
    assert V.size_estimate({"ab": "xyz", "n": None, "l": [1, "é"]}) == (2 + 3 + 5) + (1 + 3 + 1) + (1 + 3 + (17 + 5 + 2)) + 2
