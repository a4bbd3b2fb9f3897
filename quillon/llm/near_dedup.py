"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

Two permutations make a whole signature: the first takes a shingle to a place, the second, a table, is read at that place in
``K`` circular shifts, which is one contiguous row of the table. So a signature is the column-wise minimum of as many table
rows as a document has shingles. Five values make a band; documents that share a band meet in a bucket.

No step makes all pairs of a group:

1. Documents with the same shingle set are one class, found by a 128-bit digest of the set with a map-side combined count.
2. In each bucket every class is compared with the bucket's smallest one only (a star). Shingle sets are compared whole.
3. Links make components, by alternating large and small stars.
4. What a star cannot see is a class that lies outside the component of its bucket's centre but is linked with
   another member. These leftovers alone are joined with their bucket, where components differ and a 2048-bit sketch (a
   bit of each value of a longer signature) allows a similarity near the threshold, five standard errors under it. A pair
   comes out of the first band it shares only, and is compared exactly too.

Step 4 tests every pair of a bucket that is not already in one component. The sketch may reject a pair that is a link, at
the threshold with probability about 8e-7 (binomial, more for very large sets); no other link between candidates is lost.
At the threshold a pair shares a band with probability 1 - 2e-5; with similarity the chance to miss falls to nothing.

Scale: buckets, classes and stars are counted with map-side combine and joined back from written tables by plain sort-merge
joins, which adaptive execution splits where one key is hot. Shingle sets are made only for classes in a candidate pair.
Nothing is collected but two numbers per round of the component search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import slices
from .shared import Work, map_batches, read_table, whole

SHINGLE, PERCENT = 5, 75
#: Values of a signature, rows of a band, bands, and places of the second permutation (a power of two).
K, ROWS, BANDS, PLACES = 200, 5, 40, 1 << 20
#: Bits of the sketch of a class that meets another, and the similarity that it must allow: 0.75 less five standard errors.
SKETCH, SKETCH_LEAST = 2048, 0.677
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_TABLE: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def table_rows(width: int = K) -> np.ndarray:
    """Row p: the second permutation at places p, p + 1, ... p + width - 1, around the circle."""
    if not _TABLE:
        once = np.random.default_rng(20240229).permutation(PLACES).astype(np.uint32)
        _TABLE.append(np.concatenate([once, once[: SKETCH - 1]]))
    return np.lib.stride_tricks.sliding_window_view(_TABLE[0][: PLACES + width - 1], width)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    texts = pc.ascii_lower(texts)
    for c in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, c, " ")
    split = pc.split_pattern(texts, " ")
    flat = split.flatten().dictionary_encode()
    if not len(flat):
        return [np.empty(0, np.uint64)] * len(texts)
    words = flat.dictionary.to_pylist()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    full = np.fromiter(map(bool, words), bool, len(words))
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    keep = full[codes]
    before = np.append(0, np.cumsum(keep))
    hashes, offsets = of_word[codes[keep]], before[offsets]
    n = len(hashes)
    rolled = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * _M1 + hashes[k : k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = h * _M1 + hashes[k]
            out.append(_mix(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray, width: int = K) -> np.ndarray:
    rows, at = table_rows(width), (_mix(shingles * _M1) >> np.uint64(44)).astype(np.int64)
    out = np.full(width, PLACES, np.uint32)
    step = max(1, 250_000 // width)
    for k in range(0, len(at), step):
        np.minimum(out, rows[at[k : k + step]].min(0), out=out)
    return out


def sketch(long_signature: np.ndarray) -> np.ndarray:
    """The lowest bits of a signature of SKETCH values, 64 to a number."""
    return np.packbits((long_signature & 1).astype(np.uint8)).view("<i8")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; a key holds its band's number."""
    out = np.empty((len(signatures), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(signatures), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = _mix(h * _M1 + signatures[:, k])
        out[:, b] = h
    return out


def describe(df: DataFrame) -> DataFrame:
    """(doc_id, n, fa, fb, bands) per row of (doc_id, text); the last three are null for an empty set."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, limit=2_000_000):
            sets = shingle_sets(batch.column(1))
            n = np.array([len(s) for s in sets])
            none = pa.array(n == 0)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            halves = [pa.array([(d >> shift & (1 << 64) - 1) - (1 << 63) for d in digests], pa.int64()) for shift in (0, 64)]
            sigs = np.array([signature(s) for s in sets]).reshape(-1, K)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sigs).astype(np.int64).reshape(-1)))
            columns = [pc.if_else(none, pa.scalar(None, c.type), c) for c in (*halves, bands)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *columns], names=["doc_id", "n", "fa", "fb", "bands"])

    return map_batches(df.select("doc_id", "text"), "near", run, f"doc_id {id_type}, n long, fa long, fb long, bands array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose whole sets (node, shingles) reach the threshold."""

    def run(batches):
        for batch in slices(batches, text=2):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) else 0
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    left = sets.select(F.col("node").alias("a_node"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b_node"), F.col("shingles").alias("sb"))
    joined = pairs.join(left.hint("merge"), F.col("a") == F.col("a_node")).join(right.hint("merge"), F.col("b") == F.col("b_node"))
    return map_batches(joined.select("a", "b", "sa", "sb"), "near", run, "a long, b long")


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node it can reach.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its smaller ones and itself,
    to the smallest of them all. The number of rounds grows with the logarithm of a component's size.
    """
    edges, path = work.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        for large in (True, False):
            sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
            least, least_path = work.table(sides.groupBy("a").agg(F.min("b").alias("m")), "least")
            least = least.select(F.col("a").alias("l"), F.least("a", "m").alias("m"))
            met = sides.join(least.hint("merge"), F.col("a") == F.col("l"))
            moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("l").alias("a"), F.col("m").alias("b")))
            edges, new_path = work.table(moved.filter("a <> b").distinct(), "edges")
            work.drop(path)
            work.drop(least_path)
            path = new_path
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept.

    A text under five words is one shingle; a null text, or one without words, has no shingle and no link. Rows with a null
    id take part in links, are never a component's name and never kept, unless no row of the component has an id: then
    component_id is null. Repeated rows are in one component and flagged alike. An empty table gives no rows. Columns not
    named here are ignored.
    """
    work, id_type = Work(spark, "near"), df.schema[id_col].dataType
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"))
    described, _ = work.table(describe(docs), "described")
    # classes of equal sets; where no row has an id a negative number from the digest, beyond real ids, stands for it
    groups = described.filter("n > 0").groupBy("fa", "fb").agg(F.min("doc_id").alias("least"))
    ghost = -4 * (F.lit(1 << 60)) + F.shiftrightunsigned(F.col("fa"), 3)
    groups, _ = work.table(groups.withColumn("node", F.coalesce(F.col("least").cast("long"), ghost)), "classes")
    g = groups.select(F.col("fa").alias("g_fa"), F.col("fb").alias("g_fb"), "node", "least").hint("merge")
    same = (F.col("fa") == F.col("g_fa")) & (F.col("fb") == F.col("g_fb"))
    firsts = described.join(g, same).filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "n", "bands")

    # buckets of two classes or more, with their centre
    rows, _ = work.table(firsts.select("node", F.explode("bands").alias("key")), "bands")
    stars, _ = work.table(rows.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "stars")
    members, _ = work.table(rows.join(stars.select(F.col("key").alias("s_key"), "centre").hint("merge"), F.col("key") == F.col("s_key")).select("key", "node", "centre"), "members")
    pairs, _ = work.table(members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")

    # whole shingle sets of the classes that are in a bucket with another
    wanted, _ = work.table(members.select("node").distinct(), "nodes")
    ids = groups.join(wanted.select(F.col("node").alias("w_node")).hint("merge"), F.col("node") == F.col("w_node"))
    ids, _ = work.table(ids.select(F.col("node").alias("i_node"), F.col("least").alias("i_id"), F.col("fa").alias("i_fa")), "ids")

    def make_sets(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1))
            longs = [signature(s, SKETCH) for s in sets]  # a plain signature is the start of a long one
            bits, keys = np.concatenate([sketch(x) for x in longs]), band_keys(np.array([x[:K] for x in longs])).astype(np.int64).reshape(-1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * w), pa.array(v)) for w, v in ((SKETCH // 64, bits), (BANDS, keys))]
            raw = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), raw, *lists], names=["node", "n", "shingles", "bits", "bands"])

    with_id = docs.join(ids.filter("i_id IS NOT NULL").hint("merge"), F.col("doc_id") == F.col("i_id")).select("i_node", "text")
    without = docs.filter("doc_id IS NULL")
    ghosts = without.join(describe_keys(without).hint("merge"), F.xxhash64("text") == F.col("d_h")).join(ids.filter("i_id IS NULL").hint("merge"), F.col("d_fa") == F.col("i_fa")).select("i_node", "text")
    sets, _ = work.table(map_batches(with_id.unionByName(ghosts).dropDuplicates(["i_node"]), "near", make_sets, "node long, n long, shingles binary, bits array<long>, bands array<long>"), "sets")

    edges, _ = work.table(_linked(pairs, sets), "links")
    labels, _ = work.table(components(edges, work), "labels")

    # leftovers: members outside their centre's component, against their whole bucket
    lab = lambda name: labels.select(F.col("node").alias(f"{name}_n"), F.col("label").alias(f"{name}_l")).hint("merge")
    known = members.join(lab("x"), F.col("node") == F.col("x_n"), "left").withColumn("label", F.coalesce("x_l", "node")).select("key", "node", "centre", "label")
    known = known.join(lab("c"), F.col("centre") == F.col("c_n"), "left").withColumn("of_centre", F.coalesce("c_l", "centre")).select("key", "node", "centre", "label", "of_centre")
    known, _ = work.table(known, "known")
    open_keys, _ = work.table(known.groupBy("key").agg(F.max(F.col("label") != F.col("of_centre")).alias("open"), F.count(F.lit(1)).alias("size")).filter("open AND size > 2").select(F.col("key").alias("o_key")), "open")
    facts = sets.select(F.col("node").alias("f_n"), "n", "bits", "bands")
    left = known.join(open_keys.hint("merge"), F.col("key") == F.col("o_key")).filter("node <> centre").join(facts.hint("merge"), F.col("node") == F.col("f_n"))
    left, _ = work.table(left.select("key", "node", "label", "of_centre", "n", "bits", "bands"), "leftovers")
    r = left.filter("label <> of_centre").select(*[F.col(c).alias(f"r_{c}") for c in ("key", "node", "label", "n", "bits", "bands")])
    differ = F.aggregate(F.zip_with("bits", "r_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    shared = F.filter(F.zip_with("bands", "r_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    near = (
        (F.col("key") == F.col("r_key"))
        & (F.col("label") != F.col("r_label"))
        & ((F.col("label") == F.col("of_centre")) | (F.col("node") < F.col("r_node")))
        & (100 * F.least("n", "r_n") >= PERCENT * F.greatest("n", "r_n"))
        & (differ <= SKETCH * (1 - SKETCH_LEAST) / 2)
        & (F.get(shared, F.lit(0)) == F.col("key"))
    )
    more, _ = work.table(left.join(r.hint("merge"), near).select(F.col("r_node").alias("a"), F.col("node").alias("b")), "more-pairs")
    if not more.isEmpty():
        late, _ = work.table(_linked(more, sets), "late-links")
        if not late.isEmpty():
            labels, _ = work.table(components(edges.unionByName(late), work), "labels")

    named = groups.join(labels.select(F.col("node").alias("l_node"), "label").hint("merge"), F.col("node") == F.col("l_node"), "left")
    # a component is named by its smallest id; ghosts sort first and have none
    named = named.withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("name"))
    names, _ = work.table(names, "names")
    named = named.select("fa", "fb", "label").join(names.select(F.col("label").alias("n_label"), "name").hint("merge"), F.col("label") == F.col("n_label"))
    named, _ = work.table(named.select(F.col("fa").alias("c_fa"), F.col("fb").alias("c_fb"), F.col("name").cast(id_type).alias("name")), "named")
    out = described.select("doc_id", "n", "fa", "fb").join(named.hint("merge"), (F.col("fa") == F.col("c_fa")) & (F.col("fb") == F.col("c_fb")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("name"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def describe_keys(docs: DataFrame) -> DataFrame:
    """(d_h, d_fa): each text's hash and its set's digest, for rows that no id can find."""

    def run(batches):
        for batch in slices(batches, text=0):
            sets = shingle_sets(batch.column(0))
            fa = [(xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fa, pa.int64())], names=["d_h", "d_fa"])

    return map_batches(docs.select("text", F.xxhash64("text").alias("h")).dropDuplicates(["h"]), "near", run, "d_h long, d_fa long")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"))
