"""Word BPE over whole texts with a compiled lexicon of frequent words.

Three steps: count every word of all texts; compile the ``LEXICON_WORDS`` most frequent ones, with the ids that the
tokenizers library gives them, into a minimal acyclic transducer; encode all texts with it, merging all other words
exactly. Cleaning and cutting into words follow the vocabulary file: its own normaliser and pre-tokeniser handle every
text part beyond ASCII, ASCII is lowered and cut by the file's pattern. The strings of special tokens are cut out first,
as the library does.

Scale: one map-side combined count and one scan. The lexicon has a fixed bound and travels as a broadcast of a few MB. A
worker keeps the pieces it has seen, up to a bound; its memory grows with neither rows nor distinct words.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import slices
from .lexicon import Lexicon, Merges, compile_words
from .shared import Work, cache_of, map_batches, read_table, whole

#: Words of the lexicon; pieces that a worker keeps between batches.
LEXICON_WORDS, KEPT_PIECES = 100_000, 400_000
_ASCII_SPACE = "\t\n\x0b\x0c\r"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Cleaning, cutting and merging by a vocabulary file; the lexicon serves frequent words."""

    def __init__(self, path: str, blob: bytes | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        model, cut = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None
        # the file's pattern, with the space that parts pieces as one more match
        self.pattern = regex.compile(cut["pattern"]["Regex"] + "| ")
        alphabet = byte_alphabet()
        self.to_byte = {c: b for b, c in alphabet.items()}
        self.merges = Merges(model["vocab"], model["merges"], alphabet, model["end_of_word_suffix"])
        self.names = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for name, i in {**model["vocab"], **self.special}.items():
            self.names[i] = name
        self.lexicon = Lexicon(blob) if blob else None
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.id_text, self.name_text = pa.array([], pa.string()), pa.array([], pa.string())
        self.n_ids = np.empty(0, np.int64)

    def words_of(self, pieces: list[str]) -> list[list[bytes]]:
        """The words, as bytes, of each piece. A piece has no ASCII white space."""
        out: list[list[bytes]] = [[] for _ in pieces]
        plain = [i for i, p in enumerate(pieces) if p.isascii() and p]
        k = iter(plain)
        at = next(k, None)
        for m in self.pattern.findall(" ".join(pieces[i] for i in plain).lower()):
            if m == " ":
                at = next(k)
            else:
                out[at].append(m.encode("ascii"))
        for i, p in enumerate(pieces):
            if not p.isascii():
                got = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(p))
                out[i] = [bytes(self.to_byte[c] for c in w) for w, _ in got]
        return out

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has: from the lexicon, else merged."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data, begins = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(lengths) - lengths
        number = self.lexicon.find(data, begins, lengths) if self.lexicon else np.full(len(words), -1, np.int64)
        unseen = np.flatnonzero(number < 0)
        merged, n_merged = self.merges.encode(data, begins[unseen], lengths[unseen])
        counts, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        counts[unseen], at[unseen] = n_merged, np.cumsum(n_merged) - n_merged
        pool = merged
        if self.lexicon:
            seen = np.flatnonzero(number >= 0)
            counts[seen] = self.lexicon.offsets[number[seen] + 1] - self.lexicon.offsets[number[seen]]
            at[seen] = len(merged) + self.lexicon.offsets[number[seen]]
            pool = np.concatenate([merged, self.lexicon.ids])
        ends = np.cumsum(counts)
        return pool[np.repeat(at - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def _learn(self, unique: pa.Array) -> np.ndarray:
        if len(self.pieces) > KEPT_PIECES:
            self._forget()
        place = pc.index_in(unique, value_set=self.pieces)
        new = unique.filter(pc.is_null(place))
        out = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            words = self.words_of(new.to_pylist())
            distinct = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
            ids, counts = self.ids_of(list(distinct))
            ends, ids = np.cumsum(counts).tolist(), ids.tolist()
            starts = [0, *ends[:-1]]
            runs = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
            id_text = ["".join([f"{i} " for i in r]) for r in runs]
            name_text = ["".join([self.names[i] + " " for i in r]) for r in runs]
            spots = [[distinct[w] for w in ws] for ws in words]
            out[out < 0] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.id_text = pa.concat_arrays([self.id_text, pa.array(["".join([id_text[s] for s in x]) for x in spots], pa.string())])
            self.name_text = pa.concat_arrays([self.name_text, pa.array(["".join([name_text[s] for s in x]) for x in spots], pa.string())])
            self.n_ids = np.concatenate([self.n_ids, np.array([sum(len(runs[s]) for s in x) for x in spots], np.int64)])
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        for c in _ASCII_SPACE:
            texts = pc.replace_substring(texts, c, " ")
        split = pc.split_pattern(texts, " ")
        flat = split.flatten().dictionary_encode()
        if not len(flat):
            return np.zeros(len(texts), np.int64), pa.array([""] * len(texts), pa.string()), pa.array([""] * len(texts), pa.string())
        place = self._learn(flat.dictionary)[flat.indices.to_numpy(zero_copy_only=False)]
        offsets = pc.subtract(split.offsets, split.offsets[0])
        join = lambda strings: pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(pa.array(place))), "")
        return np.add.reduceat(self.n_ids[place], offsets.to_numpy()[:-1]), join(self.id_text), join(self.name_text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Per text: the number of ids, the decimal ids joined by a space, and the decoded text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        marked = np.zeros(len(texts), bool)
        for s in self.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        n, ids, names = np.zeros(len(texts), np.int64), [""] * len(texts), [""] * len(texts)
        rest = np.flatnonzero(~marked)
        if len(rest):
            n[rest], some_ids, some_names = self._plain(texts.take(pa.array(rest)))
            for i, a, b in zip(rest.tolist(), some_ids.to_pylist(), some_names.to_pylist(), strict=True):
                ids[i], names[i] = a, b
        for i in np.flatnonzero(marked).tolist():
            text, at = texts[i].as_py(), 0
            found = [*self.cut_special.finditer(text), None]
            for m in found:
                part = text[at : m.start()] if m else text[at:]
                k, a, b = self._plain(pa.array([part], pa.string()))
                n[i] += int(k[0])
                ids[i] += a[0].as_py()
                names[i] += b[0].as_py()
                if m:
                    n[i] += 1
                    ids[i] += f"{self.special[m[0]]} "
                    names[i] += m[0] + " "
                    at = m.end()
        return n, [x[:-1] for x in ids], [x[:-1] for x in names]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names) and self.names[i])


def frequent_words(df: DataFrame, tokenizer: str, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, ``limit`` at most; every text and every piece of it is counted.

    Only a histogram of the counts and the words over its cut reach the driver: pieces in bins of a sixteenth of a
    doubling, down to the last bin that fits as a whole, so ties stay together.
    """

    def run(batches):
        for batch in slices(batches, text=0):
            texts = pc.fill_null(batch.column(0), "")
            for c in _ASCII_SPACE:
                texts = pc.replace_substring(texts, c, " ")
            counts = pc.split_pattern(texts, " ").flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["piece", "n"])

    counts = map_batches(df.select("text"), "word-counts", run, "piece string, n long").filter("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n"))
    counts, _ = Work(df.sparkSession, "word-counts").table(counts.withColumn("bin", F.floor(16 * F.log2("n")).cast("int")), "counts")
    least, total = None, 0
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r.bin):
        total += r["count"]
        if total > limit:
            break
        least = r.bin
    top = [] if least is None else counts.filter(F.col("bin") >= least).orderBy(F.desc("n"), "piece").select("piece").collect()
    words: dict[bytes, None] = {}
    for ws in WordBpe(tokenizer).words_of([r.piece for r in top]):
        words.update(dict.fromkeys(ws))
    return list(words)[:limit]


def compile_lexicon(words: list[bytes], tokenizer: str) -> bytes:
    ids, counts = WordBpe(tokenizer).ids_of(words)
    ends = np.cumsum(counts)
    return compile_words({w: ids[e - c : e].tolist() for w, c, e in zip(words, counts.tolist(), ends.tolist(), strict=True)})


_LOADED: dict[tuple, WordBpe] = {}


def _loaded(path: str, key: str, blob) -> WordBpe:
    if (path, key) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, key] = WordBpe(path, blob())
    cache_of("word-bpe", _LOADED.clear)
    return _LOADED[path, key]


def encode_words(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LEXICON_WORDS, with_text: bool = True) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_text``, the ids and the decoded text.

    A null text is empty and has no ids. Null ids are carried; repeated rows are encoded each; ties among frequent words
    only decide which of them the lexicon holds, never a result. An empty table gives no rows. Other columns are ignored.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    df = df.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"))
    blob = compile_lexicon(frequent_words(df, tokenizer, limit), tokenizer)
    key, shared = hashlib.sha256(blob).hexdigest(), spark.sparkContext.broadcast(blob)

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer, key, lambda: shared.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in slices(batches, limit=6_000_000):
            n, ids, names = bpe.encode(batch.column(1))
            columns = [batch.column(0), pa.array(n), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, names), pa.string())]
            if with_text:
                columns += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=columns_of)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    columns_of = [c.split(" ")[0] for c in schema.split(", ")]
    return map_batches(df, "word-bpe", run, schema)


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_words(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_text=False)
