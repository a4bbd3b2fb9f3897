"""Whole-text byte-level BPE ids from the tokenizers library, for Arrow columns.

Encoding a column word by word repeats the same work, so a text is cut where the byte-level pattern always cuts: before
a single white-space character that stands between two others. Each distinct piece goes through the library once, many
pieces a call, and is kept for the next batches of the worker; a numpy gather then lays the ids out. Texts with two
white-space characters in a row, with white space at an end or with the string of an added token go through the
library whole. Both ways give the library's own ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import cache_of

#: White space as the byte-level pattern knows it.
_WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_WS}{_WS}|\A{_WS}|{_WS}\z"
#: Pieces sent to the library in one string; pieces kept between batches, of which the half met most often outlives an
#: overflow; bytes of text worked on at once.
_RUN, KEPT_PIECES, SLICE_BYTES = 64, 400_000, 4_000_000
#: Strings that the library gets in one call: what it makes of them is many times their size.
_CALL = 256


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.size = self.tok.get_vocab_size()
        self.starts_piece = np.zeros(self.size + 1, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.starts_piece[i] = token[0] == "Ġ" or token == "Ċ"
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.at, self.lens, self.met = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _shrink(self) -> None:
        """Keeps the half of the pieces that most batches had."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: KEPT_PIECES // 2])
        n = self.lens[keep]
        ends = np.cumsum(n)
        self.ids = self.ids[np.repeat(self.at[keep] - (ends - n), n) + np.arange(n.sum())]
        self.words, self.lens, self.at, self.met = self.words.take(pa.array(keep)), n, (ends - n).astype(np.int32), self.met[keep]

    def _encoded(self, texts: list[str]) -> Iterator:
        for k in range(0, len(texts), _CALL):
            yield from self.tok.encode_batch_fast(texts[k : k + _CALL], add_special_tokens=False)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [np.array(e.ids, np.uint32) for e in self._encoded(texts)]
        return np.concatenate([np.empty(0, np.uint32), *runs]), np.array([len(r) for r in runs], np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for pieces that follow another: "\\n..." as it is, others after a space."""
        runs = [pieces[i : i + _RUN] for i in range(0, len(pieces), _RUN)]
        ids, lens = [], []
        joined = ["".join(p if p[0] == "\n" else " " + p for p in run) for run in runs]
        for run, e in zip(runs, self._encoded(joined), strict=True):
            got = np.array(e.ids, np.uint32)
            firsts = np.flatnonzero(self.starts_piece[got])
            if len(firsts) == len(run) and firsts[0] == 0:
                ids.append(got)
                lens.append(np.diff(firsts, append=len(got)))
            else:
                got, n = self._whole([p if p[0] == "\n" else " " + p for p in run])
                ids.append(got)
                lens.append(n)
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *lens])

    def _learn(self, unique: pa.Array) -> np.ndarray:
        """Places of the distinct pieces among the kept ones, unseen ones encoded."""
        if len(self.words) > KEPT_PIECES:
            self._shrink()
        place = pc.index_in(unique, value_set=self.words)
        new = unique.filter(pc.is_null(place))
        out = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        self.met[out[out >= 0]] += 1
        if len(new):
            first = pc.starts_with(new, "\r").to_numpy(zero_copy_only=False)
            lens = np.zeros(len(new), np.int32)
            whole_ids, whole_lens = self._whole([w[1:] for w in new.filter(pa.array(first)).to_pylist()])
            rest_ids, rest_lens = self._pieces(new.filter(pa.array(~first)).to_pylist())
            lens[first], lens[~first] = whole_lens, rest_lens
            at = np.zeros(len(new), np.int32)
            base = len(self.ids)
            at[first] = base + np.cumsum(whole_lens) - whole_lens
            at[~first] = base + len(whole_ids) + np.cumsum(rest_lens) - rest_lens
            out[out < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = np.concatenate([self.ids, whole_ids, rest_ids])
            self.at, self.lens = np.concatenate([self.at, at]), np.concatenate([self.lens, lens])
            self.met = np.concatenate([self.met, np.ones(len(new), np.int32)])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has. Null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        odd = odd.to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd))
        marked = pc.replace_substring(pc.binary_join_element_wise("\r", even, ""), "\n", " \n")
        split = pc.split_pattern(marked, " ")
        flat = split.flatten().dictionary_encode()
        place = self._learn(flat.dictionary)[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int32)
        n = self.lens[place]
        total = int(n.sum(dtype=np.int64))
        index = np.int32 if total < 1 << 31 else np.int64
        ends = np.cumsum(n, dtype=index)
        at = np.repeat(self.at[place] - (ends - n), n)
        at += np.arange(total, dtype=index)
        ids = self.ids[at]
        offsets = split.offsets.to_numpy()
        counts = np.add.reduceat(n, offsets[:-1] - offsets[0], dtype=np.int64) if len(even) else np.empty(0, np.int64)
        if not odd.any():
            return ids, counts
        odd_ids, odd_counts = self._whole(texts.filter(pa.array(odd)).to_pylist())
        both = np.zeros(len(texts), np.int64)
        both[~odd], both[odd] = counts, odd_counts
        starts, out = np.cumsum(both) - both, np.empty(both.sum(), np.uint32)
        for sel, own, c in ((~odd, ids, counts), (odd, odd_ids, odd_counts)):
            out[np.repeat(starts[sel] - (np.cumsum(c) - c), c) + np.arange(len(own))] = own
        return out, both


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    cache_of("byte-bpe", _LOADED.clear)
    return _LOADED[path]


def slices(batches, text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group, at = np.cumsum(size) // limit, 0
        for end in [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]:
            yield batch.slice(at, end - at)
            at = end


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each document, and the new lengths."""
    stops = np.cumsum(counts)
    return np.insert(ids, stops, np.uint32(end)), counts + 1
