"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and
columns whose names clash with the operators' own."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quillon.llm import exact_dedup, html_text, lexicon, line_dedup, near_dedup, packing, quality_rules, token_files, toxicity, warc, word_bpe  # noqa: E402
from quillon.llm.byte_bpe import ByteBpe  # noqa: E402
from quillon.llm.shared import Work  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions near old castle walls and nobody ever asks why they do so every night under pale moon light".split()
SHORT = [
    "", " ", "one", "one", "one two", "One  two", "one\ttwo\n", "a b c d", "a b c d e", "A b c d e", "a b c d e f", "é è ê ß 日本 テスト", " x y ", "tab\tend\t", "x" * 5000, "don't it's we'RE 12345 '",
    "<|endoftext|> in <|startoftext|>text<|endoftext|>", "\x00\x1c odd \x85 marks 　", "line one is here\nline two is here\nline one is here\n\n", "&&& ### *** $$$ |", " lead", "trail ", "two  spaces",
]
CLASH = ["n", "rest", "gid", "block", "size", "kept", "keep_id", "node", "label", "a", "b", "key", "bands", "text_sha256", "score", "t", "total", "one", "low", "host", "shard", "start", "ids"]


def long_text(n=20000, step=7):
    return " ".join(PROSE[(i * step + i // 13) % len(PROSE)] + str(i % 977) for i in range(n))


def rows():
    texts = SHORT + [long_text(), long_text(), long_text() + " tail", None, None]
    for k in range(6):
        w = [PROSE[(i * 5 + k) % len(PROSE)] for i in range(80)]
        texts += [" ".join(w), " ".join([*w[:40], f"edit{k}", *w[41:]])]
    out = [(i * 3 + 1, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    return [*out, (None, "one", "en", "s1"), (None, "without an id this text stands alone here", None, None), out[2], out[30]]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- exact dedup ----


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.exact_groups(spark, docs).collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, *_ in rows():
        groups[norm(t)].append(i)
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g), sha(t)) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert max(r.n_rounds for r in got) > 3, "long copies are told apart block by block"
    assert exact_dedup.exact_groups(spark, empty).count() == 0


def test_exact_dedup_of_nulls_alone(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (None, "y"), (None, None)], "doc_id long, text string")
    got = exact_dedup.exact_groups(spark, df).collect()
    assert sorted((r.text_sha256, r.group_size) for r in got) == sorted([(sha("x"), 2)] * 2 + [(sha("y"), 1), (sha(""), 1)])
    assert all(r.keep_id is None for r in got)


def test_exact_dedup_of_one_id_with_several_texts(spark):
    tail = " the same tail of both texts" * 40
    a, b = "A" * 40 + tail, "B" * 40 + tail
    df = spark.createDataFrame([(5, a), (6, a), (5, b), (7, b), (5, "c"), (None, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(spark, df).collect())
    want = [(5, 5, 3, True, sha(a)), (6, 5, 3, False, sha(a)), (None, 5, 3, False, sha(a)), (5, 5, 2, True, sha(b)), (7, 5, 2, False, sha(b)), (5, 5, 1, True, sha("c"))]
    assert got == Counter(want)


# ---- tokens ----


def test_byte_bpe_is_the_librarys():
    bpe, tok = ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    texts = [t for _, t, *_ in rows()]
    rng = np.random.default_rng(5)
    letters = list("ab c\n\t'sé日  　<|>1.\r")
    texts += ["".join(rng.choice(letters, 30)) for _ in range(300)]
    for part in (texts, texts[::-1]):
        ids, n = bpe.encode(pa.array(part, pa.string()))
        want = [e.ids for e in tok.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_variable_length_coding():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 1001):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.vbyte_encode(v)
        assert len(control) == -(-n // 4) and token_files.vbyte_decode(control, data, n).tolist() == v.tolist()
    assert token_files.vbyte_encode(np.array([5, 300, 70000, 1 << 31], np.uint32)) == (bytes([0 | 1 << 2 | 2 << 4 | 3 << 6]), bytes([5, 44, 1, 112, 17, 1, 0, 0, 0, 128]))


def test_token_files(spark, docs, empty):
    path = Work(spark, "t").path("files")
    token_files.write_token_files(docs, BYTE, path)
    got, tok = token_files.read_token_files(spark, path).collect(), Tokenizer.from_file(BYTE)
    want = Counter((i, crc(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.n_tokens and r.ids[-1] == 0 for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    none = Work(spark, "t").path("none")
    token_files.write_token_files(empty, BYTE, none)
    assert token_files.read_token_files(spark, none).count() == 0


def test_damaged_token_files():
    head = struct.pack("<4sIIIQIII", b"QVB2", 0, 0, 1, 1, 1, 1, 1)
    good = head + struct.pack("<I", 9) + struct.pack("<q", 4) + b"\0" + struct.pack("<I", 1) + b"\0" + b"\0" + b"\n"
    ((_, _, keys, n, ids),) = token_files.blocks_of(memoryview(good))
    assert (keys.to_pylist(), n.tolist(), ids.tolist()) == ([4], [1], [9])
    for bad in (good[:-1], b"X" + good[1:], good[:-1] + b"x"):
        with pytest.raises(ValueError):
            list(token_files.blocks_of(memoryview(bad)))


def test_packing(spark, docs, empty):
    got, tok = packing.pack(docs, BYTE).collect(), Tokenizer.from_file(BYTE)
    want = Counter((i, crc(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    for i, pieces in by_doc.items():
        if i is not None and sum(1 for x in rows() if x[0] == i) == 1:
            pieces.sort(key=lambda r: r.start)
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
            assert want[i, crc([x for p in pieces for x in p.ids])] == 1
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))] and n <= 2048 and n & (n - 1) == 0
    assert packing.pack(empty, BYTE).count() == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1500, 4000)
    rows_, costs = packing.assign(lengths)
    assert rows_[:, 2].sum() == lengths.sum()
    full = np.bincount(rows_[:, 3], rows_[:, 2]) == 2048
    plain = []  # the same documents in their own order
    at = cost = 0
    for n in lengths.tolist():
        while n:
            k = min(n, 2048 - at)
            cost, at, n = cost + packing.cost(k), at + k, n - k
            if at == 2048:
                plain.append(cost)
                at = cost = 0
    assert np.std(costs[full]) < 0.75 * np.std(plain)
    assert packing.assign(np.array([], np.int64))[0].shape == (0, 5)


def test_packing_cuts_only_what_no_sequence_holds():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 1500, 3000), rng.integers(1, 5000, 1000), np.minimum(2047, rng.geometric(0.004, 3000))):
        rows_, costs = packing.assign(lengths)
        room, used = np.bincount(rows_[:, 3], rows_[:, 2]), np.zeros(len(costs))
        whole, n_full = lengths // 2048, int((lengths // 2048).sum())
        free, n_cut = room.copy(), 0
        free[:n_full], done = 0, (lengths - lengths % 2048).copy()
        full = room == 2048
        for d, start, n, s, _ in rows_[n_full:].tolist():
            left = lengths[d] - done[d]
            fits = np.flatnonzero(full & (free >= left))
            if n < left:
                n_cut += 1
                assert free.max() < left, "a tail is cut although a sequence has room"
            elif full[s]:
                assert used[s] == used[fits].min()
            done[d], free[s], used[s] = done[d] + n, free[s] - n, used[s] + packing.cost(n)
        assert (done == lengths).all() and not free.any() and n_cut < len(lengths) and whole.sum() == n_full


def test_packing_carries_a_windows_rest_on(spark):
    df = spark.createDataFrame([(k, " ".join(PROSE[(k * j) % len(PROSE)] for j in range(30 + k % 70))) for k in range(400)], "doc_id long, text string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = packing.pack(df, BYTE).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    room, tok = Counter(), Tokenizer.from_file(BYTE)
    by_doc = defaultdict(list)
    for r in got:
        room[r.sequence_id] += r.length
        by_doc[r.doc_id].append(r)
    assert sum(n for n in room.values() if n < 2048) < 2048 < sum(room.values())
    for i, t in df.collect():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert [x for r in pieces for x in r.ids] == tok.encode(t, add_special_tokens=False).ids + [1] and all(r.doc_tokens == sum(p.length for p in pieces) for r in pieces)


def test_word_bpe(spark, docs, empty):
    got, tok = word_bpe.encode_words(docs, WORD, limit=40).collect(), Tokenizer.from_file(WORD)
    want = Counter()
    for i, t, *_ in rows():
        e = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(e), sha(" ".join(map(str, e))), sha(tok.decode(e, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(" ".join(map(str, r.ids)) == "" or sha(r.decoded) == r.decoded_sha256 for r in got)
    assert word_bpe.encode_words(empty, WORD).count() == 0


def test_word_bpe_on_odd_texts():
    tok, rng = Tokenizer.from_file(WORD), np.random.default_rng(9)
    letters = list("ab c\ńéÉ ’'sS1٣<|>日‍ İß😀ςΣ\x1c\x85 ")
    texts = ["".join(rng.choice(letters, 40)) for _ in range(400)] + ["İstanbul ΣΑΣ", "́start", "ﬁ Å ẞ", "x" * 3000, "a<|endoftext|>b"]
    n, ids, names = word_bpe.WordBpe(WORD, word_bpe.compile_lexicon([b"ab", b"c", b"abc", "é".encode()], WORD)).encode(pa.array(texts))
    for t, k, i, m in zip(texts, n, ids, names, strict=True):
        e = tok.encode(t, add_special_tokens=False).ids
        assert (k, i, m) == (len(e), " ".join(map(str, e)), tok.decode(e, skip_special_tokens=False)), t


def test_long_words_are_merged_exactly_and_fast():
    import time

    tok, rng, bpe = Tokenizer.from_file(WORD), np.random.default_rng(12), word_bpe.WordBpe(WORD)
    texts = ["".join(rng.choice(list(letters), n)) for letters in ("ab", "aaaaab", "thein", "étaßo") for n in (255, 256, 257, 700, 3000)]
    n, ids, _ = bpe.encode(pa.array(texts))
    for t, k, i in zip(texts, n, ids, strict=True):
        assert (k, i) == (len(e := tok.encode(t, add_special_tokens=False).ids), " ".join(map(str, e)))
    began = time.time()
    n, ids, _ = bpe.encode(pa.array(["".join(rng.choice(list("abcdefgh"), 1_000_000)), "a" * 200_000]))
    assert len(ids[0].split()) == n[0] > 200_000 and time.time() - began < 30


def test_lexicon_is_minimal_and_finds_its_words():
    words = sorted({f"{a}{b}ing".encode() for a in ("walk", "talk", "jump", "w") for b in ("", "e", "er")} | {b"w", b"zing"})
    entries = {w: [k, k + 1] for k, w in enumerate(words)}
    lex = lexicon.Lexicon(lexicon.compile_words(entries))
    probe = [*words, b"", b"wal", b"walkingx", b"q", b"walk"]
    data, lengths = np.frombuffer(b"".join(probe), np.uint8).astype(np.int64), np.array(list(map(len, probe)))
    number = lex.find(data, np.cumsum(lengths) - lengths, lengths)
    assert number.tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    assert all(lex.ids[lex.offsets[k] : lex.offsets[k + 1]].tolist() == entries[w] for k, w in enumerate(words))
    # states that accept the same endings are one: count them by their right languages
    endings = {w[:k]: frozenset(x[k:] for x in words if x.startswith(w[:k])) for w in words for k in range(len(w) + 1)}
    assert len(lex.finals) == len(set(endings.values()))
    assert lexicon.Lexicon(lexicon.compile_words({})).find(data, np.cumsum(lengths) - lengths, lengths).tolist() == [-1] * len(probe)


# ---- quality ----


def test_quality(spark, docs, empty):
    got = quality_rules.quality(spark, docs).collect()
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        want[(i, *base, len(w) < 50 or 100 * len(rep) > 50 * len(w))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and all(r.kept for r in got if r.n_words > 70 and not r.base_failed)
    assert quality_rules.quality(spark, empty).count() == 0


def test_thresholds_follow_the_group_and_sketches_merge(spark):
    def prose(k, mark=""):
        return " ".join(f"{PROSE[(i * 7 + k) % len(PROSE)]}{(i * (k % 88 + 1)) % 89}{mark}" for i in range(60))

    data = [(k, prose(k), "en", "a") for k in range(250)] + [(1000 + k, prose(k, "###"), "en", "a") for k in range(20)]
    data += [(2000 + k, prose(k, "#"), "xx", "code") for k in range(250)] + [(3000, prose(3, "###"), "en", "tiny"), (3001, prose(3), "en", "tiny")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality(spark, df).collect()}
    assert all(kept[k] for k in range(250)) and not any(kept[1000 + k] for k in range(20))
    assert all(kept[2000 + k] for k in range(250)), "what is usual in a group stays"
    assert kept[3001] and not kept[3000], "a small group takes its language's thresholds"
    m = quality_rules.with_measures(df, F.col("text"))
    whole = {tuple(r)[:4]: r.n for r in quality_rules.sketches(m).collect()}
    parts = Counter()
    for k in range(3):
        parts.update({tuple(r)[:4]: r.n for r in quality_rules.sketches(m.filter(F.col("doc_id") % 3 == k)).collect()})
    assert parts == whole


def test_every_measures_fence_follows_the_groups_tail(spark):
    """Two groups whose upper tenths differ in one measure have different fences for it, and agree in the others."""
    rng = np.random.default_rng(7)
    for m in quality_rules.GUARD:
        zero = {x: np.zeros(600, int) for x in quality_rules.GUARD} | {"word_len": np.full(600, 5000)}
        zero[m] = zero[m] + np.where(np.arange(600) % 300 >= 240, rng.integers(5, 300, 600) * np.where(np.arange(600) < 300, 1, 3), 0)
        rows = [(i, "en", "a" if i < 300 else "b", False, *(int(zero[x][i]) for x in quality_rules.GUARD)) for i in range(600)]
        df = spark.createDataFrame(rows, "doc_id long, lang string, source string, base_failed boolean, " + ", ".join(f"{x} long" for x in quality_rules.GUARD))
        t = {r.t_source: r.t for r in quality_rules.thresholds(quality_rules.sketches(df)).collect()}
        for x in quality_rules.GUARD:
            assert (t["a"][f"high_{x}"] < t["b"][f"high_{x}"]) == (x == m)
            values = np.sort(zero[x][:300])
            q = [int(v) if v < 64 else int(v) >> int(v).bit_length() - 6 << int(v).bit_length() - 6 for v in (values[149], values[269])]
            assert t["a"][f"high_{x}"] == q[1] + quality_rules.REACH * (q[1] - q[0]) + quality_rules.GUARD[x]


# ---- archives ----


def test_archives(spark):
    html = ["<p>x</p>", "", None, "<p>x</p>", "é" * 100, "<p>x</p>", "long " * 20000, "long " * 20000]
    data = [(10 - i, f"http://h/{i} x" if i else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", "<p>x</p>", ""), (30, "u", "é", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, sha string").withColumn("first", F.lit(1)).repartition(3)
    path = Work(spark, "w").path("a")
    warc.write_archives(df, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    payloads = {i: (h or "").encode() for i, _, h, _ in data}
    for i, p in payloads.items():
        first = min(k for k, q in {x: y for x, y in payloads.items() if x is not None}.items() if q == p) if i is not None else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i in (first, None) else ("revisit", first))
        assert (bytes(r.payload) if r.payload is not None else None) == (p if r.record_type == "response" else None)
    assert warc.read_archives(spark, path).count() == len(data)
    large = Work(spark, "w").path("b")
    warc.write_archives(df, large, min_bytes=100)
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, large, False).collect()}
    assert kinds[5] == "response" and kinds[4] == "revisit"
    none = Work(spark, "w").path("c")
    warc.write_archives(df.filter("false"), none)
    assert warc.read_archives(spark, none).count() == 0


def test_archive_files_are_plain_zstandard_and_checked():
    import zstandard

    raw = [warc.record(k, f"http://x/{k}", f"<p>page {k} {'text ' * k}</p>".encode() * 30, None) for k in range(40)]
    dictionary, lead = warc.dictionary_frame(raw)
    assert dictionary and lead[:4] == bytes.fromhex("5d2a4d18")
    data = zstandard.ZstdCompressionDict(dictionary)
    coder = zstandard.ZstdCompressor(dict_data=data)
    archive = lead + b"".join(coder.compress(r) + warc.SEPARATOR.encode() for r in raw)
    plain = zstandard.ZstdDecompressor(dict_data=data)
    assert [r["page_id"] for r in warc.records(memoryview(archive))] == list(range(40))
    assert plain.decompress(coder.compress(raw[3])) == raw[3]
    noisy = coder.compress(np.random.default_rng(1).bytes(400_000))
    assert [len(f) for _, f in warc.frames(memoryview(noisy))] == [len(noisy)]
    for bad in (archive[:-12], archive[: len(lead) + 5], archive + b"junk", archive + lead):
        with pytest.raises(warc.ArchiveError):
            list(warc.records(memoryview(bad)))
    good = raw[5]
    for old, new in ((b"WARC/1.1", b"HTTP/1.1"), (b"Content-Length: ", b"Content-Length: 9"), (b"WARC-Date", b"X-Date"), (b"page 5", b"page 6"), (b"WARC-Type: response", b"WARC-Type: strange")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(good.replace(old, new, 1))
    for page in (0, 1, -1, (1 << 63) - 1, -(1 << 63)):
        assert warc.page_of(warc.record_id(page)) == page


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Top</header><nav><a>Menu</a></nav>
<div id=content><h2>Head &amp; {k}</h2><p>Body  of page {k}<br>goes<p>Second <b>bold {k}</b> part<ul><li>one {k}<li>two {k}</ul><p>Share this page now</div>
<div class="sidebar"><p>Side</div><form>Form</form><section class="comments"><p>Reader says {k}</section><script>if (a<b) {{"</p>"}}</script><footer>Foot</footer></body>"""


def test_pages(spark):
    data = [(k, f"https://Site.example/{k}", PAGE.format(k=k), "x") for k in range(12)]
    data += [(100, "http://other.example/", PAGE.format(k=1), "x"), (101, None, None, "x"), (102, "nohost", "", "x"), (103, "http://a.b", "just text & more", "x"), (None, "http://a.b", "<p>a</p><p>b", "x"), (104, "u", "<p>cut <b", "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, low string").withColumn("host", F.lit(1)).repartition(3)
    got = {r.page_id: r for r in html_text.extract(spark, df).collect()}
    body = "Head & {k}\nBody of page {k} goes\nSecond bold {k} part\none {k}\ntwo {k}"
    for k in range(12):
        assert got[k].text == body.format(k=k) and got[k].n_removed == 1, "what every page of a site says goes"
        assert got[k].n_chars == len(got[k].text)
    assert got[100].text == body.format(k=1) + "\nShare this page now", "one page of a site shows nothing of its tree"
    assert (got[101].text, got[102].text, got[103].text, got[None].text, got[104].text) == ("", "", "just text & more", "a\nb", "cut")
    assert html_text.extract(spark, df.filter("false")).count() == 0


def test_article_alone_is_read():
    page = html_text.Page('<body><p>Outside</p><article class="post"><header><h1>Title</h1></header><p>Text &#233; &lt;b&gt;</p><aside>No</aside><div class="ad">No</div></article><p>After</p>')
    assert page.blocks(set()) == (["Title", "Text é <b>"], 0)
    page = html_text.Page('<article><h1>T</h1><p class="related-work">Main para</p><div class="skip">two</div><p>end</p></article>')
    assert page.blocks(set())[0] == ["T", "Main para", "two", "end"]
    for broken in ("<", "<<<>>>", "</p></div>", "<p", '<a href="x', "<!--", "<script>x", "<p title='>'>ok", "&#xZ; &amp &nosuch;"):
        html_text.Page(broken)


def test_the_style_tree_against_plain_python(spark):
    """The figures of the merged tree by hand: entropy of child sequences, shares of equal branches, low branches removed whole."""
    import math

    def source(k):
        tail = "<section><h3>More here</h3><ul><li>first</li><li>second</li></ul></section>" * (k % 10 < 8)
        return f"<html><body><div class=x><p>own text of page {k}</p>{'<p>twice</p>' * (k % 3 == 0)}</div>{tail}<p>Call us</p></body></html>"

    data = [(k, f"http://h.example/{k}", source(k)) for k in range(30)] + [(100 + k, f"http://h.example/c{k}", source(0)) for k in range(200)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in html_text.extract(spark, df).collect()}
    pages = {k: html_text.Page(source(k)) for k in range(30)}
    n_style, n_branch, m = defaultdict(Counter), Counter(), 30
    for p in pages.values():
        for path, style in {(a, tuple(b)) for a, b in zip(p.paths, p.styles)}:
            n_style[path][style] += 1
        n_branch.update({(a, b) for a, b in zip(p.paths, p.branches()) if b})
    entropy = {path: -sum(n / sum(c.values()) * math.log(n / sum(c.values()), m) for n in c.values()) for path, c in n_style.items()}
    low = {b for (path, b), n in n_branch.items() if n >= 0.5 * m and 0.1 * entropy[path] + 0.9 * (1 - math.log(n, m)) < 0.2}
    assert low and max(entropy.values()) > 0.1
    for k, p in pages.items():
        texts, removed = p.blocks(low)
        assert (got[k].text, got[k].n_removed) == ("\n".join(texts), removed)
        assert texts == [f"own text of page {k}", *["twice"] * (k % 3 == 0) * 1] and removed == 1 + 3 * (k % 10 < 8)
    assert all(got[100 + k].text == got[0].text for k in range(200)), "copies of a page do not make its text boilerplate"


def test_deep_and_damaged_pages_take_linear_time():
    import time

    began = time.time()
    for part in ("<div>", "<b>x</i>", "<p>x<div>", "<li><b>y", "<table><tr><td>z"):
        page = html_text.Page(part * (1_000_000 // len(part)))
        page.branches()
        page.blocks({1})
    assert html_text.Page("a" * 1_000_000).blocks(set()) == (["a" * 1_000_000], 0)
    assert time.time() - began < 60


# ---- lines ----


def test_lines(spark, docs, empty):
    data = [(k, f"common line for all\nown line number {k}\n\nshared by a few sites {k % 2}\nshort", f"s{k % 12}") for k in range(60)]
    data += [(100, None, "s1"), (101, "", None), (102, "Common  line FOR all", None), (102, "Common  line FOR all", None), (None, "common line for all\nx", "s3")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("key", F.lit("x")).repartition(3)
    got = line_dedup.remove_lines(spark, df, max_sites=6).collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(data) and all(r.text_sha256 == sha(r.text) for r in got)
    assert text[7] == "own line number 7\n\nshared by a few sites 1", "six sites are not over six"
    assert (text[100], text[101], text[102], text[None]) == ("", "", "", "x")
    few = {r.doc_id: r.text for r in line_dedup.remove_lines(spark, df, max_sites=5).collect()}
    assert few[7] == "own line number 7\n", "near the threshold counts are exact, and a line of one word is judged too"
    assert {r.doc_id: r.text for r in line_dedup.remove_lines(spark, df).collect()}[7] == "own line number 7\n", "14 sites, so three may share a line"
    assert line_dedup.remove_lines(spark, docs).count() == docs.count() and line_dedup.remove_lines(spark, empty).count() == 0


# ---- near duplicates ----


def near_brute(data):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in data:
        w = WORDS.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] * bool(w)))
    label = list(range(len(data)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(data)):
        members[find(i)].append(data[i][0])
    names = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((d[0], len(s), names[find(i)] if s else d[0]) for i, (d, s) in enumerate(zip(data, sets, strict=True)))


def test_near_dedup(spark, docs, empty):
    got = near_dedup.near_duplicates(spark, docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_brute(rows())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(spark, empty).count() == 0


def test_near_dedup_of_chains(spark):
    """Each text is like the next ones only: links outside the stars of buckets must hold chains together."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(100)]
    data = []
    for c in range(6):
        w = [f"c{c}{x}" for x in base]
        for k in range(25):
            w = list(w)
            for j in rng.choice(100, 2, replace=False):
                w[j] = f"c{c}k{k}j{j}"
            data.append((int(rng.integers(1 << 40)), " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(spark, df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_brute(data)


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.75, 0.9):
        a = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        k = round(800 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 1 << 63, 800 - k, dtype=np.uint64)])
        est = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
        assert abs(est - share) < 0.12
        bits = np.bitwise_count(np.bitwise_xor(*(near_dedup.sketch(near_dedup.signature(x, near_dedup.SKETCH)) for x in (a, b))).view(np.uint64)).sum() / near_dedup.SKETCH
        assert abs(1 - 2 * bits - share) < 0.08
    rows_ = near_dedup.table_rows()
    assert rows_[4][1:].tolist() == rows_[5][:-1].tolist() and rows_[-1][1:].tolist() == rows_[0][:-1].tolist(), "one table, shifted around a circle"


def test_components(spark):
    import random

    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    r.shuffle(edges)
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "cc")).collect()
    assert {x.node: x.label for x in got} == label and len(got) == len(label)


# ---- toxicity ----


def restorer():
    text = ("you stupid idiot loser what a moron the total scum and trash ass are here with us today it is pathetic and worthless " + " ".join(PROSE) + " ") * 30
    words = Counter(text.split())
    return toxicity.Restorer(toxicity.CharacterModel(toxicity.trigram_counts(list(words), np.array(list(words.values())))))


def test_restoring():
    r = restorer()
    want = {"tr4sh": "trash", "1d10t": "idiot", "stuuupid": "stupid", "s.t.u.p.i.d": "stupid", "l0s3r!!": "loser", "m0r0n###": "moron", "p@thetic": "pathetic", "stupid": "stupid", "Trash,": "trash", "": "", "###": ""}
    want |= {"mmoron": "moron", "lloser": "loser", "sstupid": "stupid", "stuupid": "stupid", "iidiioott": "idiot", "ttrraasshh": "trash", "idio+": "idiot", "455": "ass", "moron123": "moron", "TRASH!!": "trash"}
    assert {w: r.word(w) for w in want} == want
    pieces = ["ab", "é#1", ""]
    brute = Counter()
    for p, n in zip(pieces, (2, 1, 3), strict=True):
        c = [0, 0, *toxicity.classes_of(p).tolist(), 0]
        for k in range(2, len(c)):
            brute[(c[k - 2] * 64 + c[k - 1]) * 64 + c[k]] += n
    got = toxicity.trigram_counts(pieces, np.array([2, 1, 3]))
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == brute


def all_readings(model, seen):
    """Every path through the lattice of a short word, with its cost: (cost, text)."""
    kind = lambda y: int(toxicity.classes_of(y)[0])
    out = []

    def walk(i, a, b, text, total):
        if i == len(seen):
            out.append((total + (model.cost[(a * 64 + b) * 64] if a or b else 0.0), text))
            return
        x, same = seen[i], i > 0 and seen[i - 1] == seen[i]
        if x == " ":
            single = seen[i - 2 : i - 1] in ("", " ") and seen[i + 2 : i + 3] in ("", " ")
            if a or b:
                walk(i + 1, 0, 0, text + " ", total + model.cost[(a * 64 + b) * 64] + (toxicity.PART_SINGLE if single else 0))
                walk(i + 1, a, b, text, total + (toxicity.JOIN_SINGLE if single else toxicity.JOIN))
            else:
                walk(i + 1, 0, 0, text, total)
            return
        for y, price in [(x, 0.0), *((y, toxicity.SUBSTITUTE) for y in toxicity.LOOKALIKES.get(x, ""))]:
            walk(i + 1, b, kind(y), text + y, total + price + model.cost[(a * 64 + b) * 64 + kind(y)])
            if same and kind(y) == b:
                walk(i + 1, a, b, text, total + (0.0 if seen[i - 2 : i - 1] == x else toxicity.REPEAT))
        if not x.isalnum():
            walk(i + 1, a, b, text, total + (0.0 if same else toxicity.DROP))

    walk(0, 0, 0, "", 0.0)
    return out


def test_the_search_finds_the_likeliest_of_all_readings():
    model, rng = restorer().model, np.random.default_rng(11)
    words = ["1d10t", "mm0rr", "s t u", "s tu p", "a$$!!", "..x", "l0 $er", "!!!!", "ttt", "", "t-r-4", "a b", "0 0"]
    words += ["".join(rng.choice(list("aasmtio01$!. -"), 6)).strip() for _ in range(150)]
    for w in words:
        w = re.sub(" +", " ", w)
        cost, text = model.decode(w)
        readings = all_readings(model, w)
        assert abs(cost - min(c for c, _ in readings)) < 1e-4, w
        assert min(c for c, t in readings if t == text) < cost + 1e-4, w


def test_restoring_reaches_every_sign_of_the_channel():
    r = restorer()
    found = toxicity.Words(r, {f: i for i, f in enumerate(["moron$", "stupid$", "loser$", "scum$", "stupi"])})
    texts = ["a mo ron here", "st up id.", "l os er", "m0 r0n", "sc um", "mo", "ron", "s t u p i d", "s  t  u  p  i  d", "stuupid", "stu pid", "so s t u p i d m o r o n", "5 + u p ! d", "stupidly"]
    assert found.texts(pa.array(texts)) == [{0}, {1, 4}, {2}, {0}, {3}, set(), set(), {1, 4}, {1, 4}, {1, 4}, {1, 4}, {0, 1, 4}, {1, 4}, {4}]
    assert found.texts(pa.array([" ".join(PROSE), "", " ", "\n\t"])) == [set()] * 4
    # the gates let through whatever the lattice reads as a feature
    plain, rng = toxicity.Words(r), np.random.default_rng(6)
    for _ in range(300):
        word = list(str(rng.choice(["moron", "stupid", "loser", "scum"])))
        for k in rng.choice(len(word), 2, replace=False):
            look = [c for c, ys in toxicity.LOOKALIKES.items() if word[k] in ys]
            word[k] = str(rng.choice([*look, word[k] * 2, word[k] * 7, word[k].upper(), word[k] + "."]))
        text = pa.array(["".join(word)])
        named = {f: i for f, i in found.known.items() if f in plain.texts(text)[0]}
        assert found.texts(text) == [set(named.values())], text
    assert toxicity.Words(r, {}).texts(pa.array(texts)) == [set()] * len(texts)


def test_long_words_take_linear_time():
    import time

    found, began = toxicity.Words(restorer(), {"moron$": 0, "mor": 1}), time.time()
    assert found.texts(pa.array(["m" * 1_000_000 + "oron", "mo" + "r" * 1_000_000 + "on", "m" * 500_000 + " " + "o" * 500_000])) == [{0, 1}, {0, 1}, set()]
    long = "m0rx1" * 200_000
    assert found.texts(pa.array([long, "x" * 1_000_000, "m.o " * 250_000])) == [{1}, set(), set()]
    assert time.time() - began < 30


def test_words_that_spaces_part_are_read_whole():
    r, rng = restorer(), np.random.default_rng(4)
    # any feature, however many are stronger; words of any length in characters; pieces that are a feature and begin a longer one
    found = toxicity.Words(r, {f"zq{i:03d}x$": i for i in range(300)} | {"stupid$": 300, "ass$": 301, "loser$": 302, "stupi": 303})
    texts = ["st upid", "s" + "-" * 40 + " t u p i d", "l os " + "e" * 90 + " r here", "l " + "- _ " * 30 + "o s e r", "stupi d", "as s", "l" + " !" * 200 + " o s e r"]
    assert found.texts(pa.array(texts)) == [{300, 303}, {300, 303}, {302}, {302}, {300, 303}, {301}, {302}]
    # against the lattice over the whole text from every piece on, without gates
    words = ["moron", "stupid", "loser", "ass", "idiot", "worthless", "the", "total", "us", "a"]
    found = toxicity.Words(r, {f: i for i, f in enumerate(["moron$", "stupid$", "stupi", "loser$", "ass$", "idiot$", "worthl", "worthless$", "the$", "tot$"])})
    for _ in range(400):
        text = ""
        for word in rng.choice(words, 4):
            spaces, noise = rng.choice([0, 0.3, 1]), rng.random(len(word))
            for c, u in zip(word, noise, strict=True):
                look = [x for x, ys in toxicity.LOOKALIKES.items() if c in ys] or [c]
                text += str(rng.choice(look)) if u < 0.1 else c * int(rng.choice([2, 40])) if u < 0.2 else c + str(rng.choice(["-", "!", "*_" * 20])) if u < 0.3 else c
                text += " " * int(rng.random() < spaces) + "- | " * int(rng.random() < 0.03)
            text += " "
        pieces = text.split()
        want = {i for p in pieces for i in found._piece(p)} | {i for a in range(len(pieces) - 1) for i in found._run((*pieces[a:], False))}
        assert found.texts(pa.array([text])) == [want], text


def test_many_parted_pieces_take_linear_time():
    import time

    found, began = toxicity.Words(restorer(), {"idiot$": 0, "ass$": 1, "loser$": 2}), time.time()
    texts = ["i " * 300_000, "! " * 300_000 + "d i o t", "i d i o t " * 60_000, "l " + "- " * 300_000 + "oser", "a s " * 100_000, "| - " * 2000 + "o s e r", "x " + "l - _ * " * 2000]
    assert [found.texts(pa.array([t]))[0] for t in texts] == [set(), {0}, {0}, {2}, set(), {2}, set()]
    assert time.time() - began < 60


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    bad, data, labels = ["moron", "idiot", "scum"], [], []
    for k in range(600):
        w = [str(x) for x in rng.choice(PROSE, 40)]
        toxic = k % 5 == 0
        if toxic:
            for j in rng.choice(40, 3, replace=False):
                w[j] = str(rng.choice(bad))
        data.append((k, " ".join(w), "l"))
        labels.append((k, int(toxic)))
    data += [(1001, " ".join(PROSE) + " m0r0n 1d10t", None), (1002, " ".join(PROSE) + " m o r o n " + " s.c.u.m", None), (1003, None, None), (1004, "", None), (None, "idiot scum moron", None), (1005, " ".join(PROSE * 300), None), (7, data[7][1], "l")]
    labels += [(None, 1), (3, None), (5, 0), (99999, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic string").withColumn("l_doc_id", F.lit(1)).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None) and not by[None].held_out
    wrong = sum(r.predicted != (r.doc_id % 5 == 0) for r in got if r.held_out and r.doc_id < 600)
    assert wrong <= 2
    assert by[1001].predicted and by[1002].predicted and by[None].predicted
    assert not (by[1003].predicted or by[1004].predicted or by[1005].predicted) and by[1003].score == by[1004].score
    assert {r.predicted for r in toxicity.toxicity(df, lab.filter("toxic = 0")).collect()} == {0}
    assert toxicity.toxicity(df.filter("false"), lab.filter("false")).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    data = [(k, " ".join(PROSE[k % 7 :] + ["moron"] * (k % 4 == 0))) for k in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    score = lambda lab: {r.doc_id: r.score for r in toxicity.toxicity(df, spark.createDataFrame(lab, "doc_id long, toxic int")).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    assert score([(k, int(k % 4 == 0)) for k in range(120)]) == score([(k, int(held(k) or k % 4 == 0)) for k in range(120)])


# ---- queries and pipeline ----


def test_queries_are_registered():
    from quillon.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline(spark, sf):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, before = documents, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, _ = Work(spark, "p").table(stage(spark, docs, sf), f"stage{k}")
        got = out.collect()
        here = {r.doc_id: r.text for r in docs.collect()}
        if k < 4:
            assert out.columns == documents.columns and {r.doc_id for r in got} <= set(here)
        kept = {r.doc_id for r in got}
        if k == 0:
            assert kept == {r.doc_id for r in quality_rules.quality(spark, docs).collect() if r.kept}
        elif k == 1:
            assert len(kept) >= 0.8 * len(here)
        elif k == 2:
            first = {}
            for i in sorted(here):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", here[i] or ""), i)
            assert kept == set(first.values())
        elif k == 3:
            assert kept == {i for i, _, c in near_brute(sorted(here.items())) if i == c}
        else:
            tok = Tokenizer.from_file(BYTE)
            assert {r.doc_id: r.doc_tokens for r in got} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in here.items()}
        docs, before = out, kept
    assert corpus_pipeline.ORACLE_SQL is None and before


def test_pipeline_on_odd_rows(spark, docs, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns or name == "packing"
        assert out.count() <= docs.count() or name == "packing"
        assert stage(spark, empty, str(tmp_path)).count() == 0
