"""A lexicon of frequent words as a minimal acyclic transducer, and exact merging of all other words.

The words' byte strings form an automaton in which equal suffixes share their states. Outputs stand on the arcs: summed
along a word's path they give its number, and that number's run of ids in a table. The automaton is three flat arrays, sorted
by ``state, byte``, in one file that workers map into memory; a column of words is walked at once, a byte a step.
Words outside the lexicon are merged as the vocabulary says - always the pair of least rank, the leftmost of equals - for
many words at once, and long words one by one over a heap.
"""

from __future__ import annotations

import heapq
import mmap
import tempfile

import numpy as np

_MAGIC, _NO = b"QLEX0001", np.iinfo(np.int64).max
#: Bytes of a word from which on it is merged by itself, in n log n steps.
LONG = 256


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton's file for words and their ids. Words must not be empty."""
    words = sorted(entries)
    # a state: [final, arcs {byte: state}]; registered states are shared by equal final flag and arcs
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs_of: list[list[tuple[int, int]]] = []
    below: list[int] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(finals)
            finals.append(final)
            arcs_of.append(arcs)
            below.append(final + sum(below[t] for _, t in arcs))
        return register[key]

    path: list[list] = [[False, []]]
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        fold(common)
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    fold(0)
    root = settle(*path[0])
    keys, targets, outputs = [], [], []
    for s, arcs in enumerate(arcs_of):
        number = int(finals[s])
        for byte, t in arcs:
            keys.append(s << 8 | byte)
            targets.append(t)
            outputs.append(number)
            number += below[t]
    runs = [entries[w] for w in words]
    offsets = np.cumsum([0, *map(len, runs)])
    ids = [i for r in runs for i in r]
    arrays = [np.array(x, "<i8") for x in (keys, targets, outputs, finals, offsets, ids)]
    head = np.array([root, *map(len, arrays)], "<i8").tobytes()
    return _MAGIC + head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled automaton, mapped into memory from a file of its own that no folder lists."""

    def __init__(self, blob: bytes):
        if blob[:8] != _MAGIC:
            raise ValueError("not a lexicon")
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, "<i8", 7, 8)
        self.root, at, arrays = int(head[0]), 64, []
        for n in head[1:].tolist():
            arrays.append(np.frombuffer(self._map, "<i8", n, at))
            at += 8 * n
        self.keys, self.targets, self.outputs, self.finals, self.offsets, self.ids = arrays

    def find(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word data[begin : begin + length], -1 for those that aren't in the lexicon."""
        number, state = np.zeros(len(begins), np.int64), np.full(len(begins), self.root)
        out = np.full(len(begins), -1, np.int64)
        live = np.arange(len(begins)) if len(self.keys) else np.empty(0, np.int64)
        for step in range(int(lengths.max(initial=0)) + 1):
            ended = lengths[live] == step
            stop = live[ended]
            good = stop[self.finals[state[stop]] > 0]
            out[good] = number[good]
            live = live[~ended]
            if not len(live):
                break
            want = state[live] << 8 | data[begins[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[arc] == want
            live, arc = live[hit], arc[hit]
            number[live] += self.outputs[arc]
            state[live] = self.targets[arc]
        return out


class Merges:
    """Byte-pair merging of whole words, many at a time."""

    def __init__(self, vocab: dict[str, int], merges: list, alphabet: dict[int, str], word_end: str):
        size = max(vocab.values()) + 1
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        key = pairs[:, 0] * size + pairs[:, 1]
        # where a pair is listed twice the last rank holds, as in a map that is filled in order
        key, rank = np.unique(key[::-1], return_index=True)
        self.size, self.key, self.rank = size, key, len(pairs) - 1 - rank
        self.made = pairs[:, 2]
        self.first = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[alphabet[b] + word_end] for b in range(256)], np.int64)
        self.table: dict[int, tuple[int, int]] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        ok = (a >= 0) & (b >= 0) & (self.key[at] == want) if len(self.key) else np.zeros(a.shape, bool)
        return np.where(ok, self.rank[at] if len(self.key) else 0, _NO)

    def encode(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        counts, order = np.zeros(len(begins), np.int64), np.argsort(lengths, kind="stable")
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            end = at + 1
            if lengths[order[at]] >= LONG:
                block = order[at:end]
                runs.append((block, self._long(data[begins[order[at]] : begins[order[at]] + lengths[order[at]]])))
                counts[block] = len(runs[-1][1])
                at = end
                continue
            # a block has words of about the same length and a bounded number of cells
            widest = max(8, int(lengths[order[at]]) * 5 // 4)
            end = max(end, min(int(np.searchsorted(lengths[order], widest, "right")), at + max(1, 1_000_000 // widest)))
            block = order[at:end]
            runs.append((block, self._block(data, begins[block], lengths[block], counts, block)))
            at = end
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for block, ids in runs:
            n = counts[block]
            out[np.repeat(starts[block] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one long word: a heap of (rank, place) over a linked list of its parts."""
        if not self.table:
            self.table = {k: (r, self.made[r].item()) for k, r in zip(self.key.tolist(), self.rank.tolist(), strict=True)}
        ids, n, get, size = self.first[raw].tolist(), len(raw), self.table.get, self.size
        ids[-1] = self.last[raw[-1]].item()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self._ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found.tolist()) if r != _NO]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            # parts that were merged since have other ids, or none
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[rank].item(), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (pair := get(ids[k] * size + ids[m])):
                    heapq.heappush(heap, (pair[0], k, ids[k], ids[m]))
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def _block(self, data, begins, lengths, counts, block) -> np.ndarray:
        width = int(lengths.max(initial=1))
        cols = np.arange(width)
        inside = cols < lengths[:, None]
        raw = data[np.where(inside, begins[:, None] + cols, begins[:, None])]
        ids = np.where(inside, np.where(cols == lengths[:, None] - 1, self.last[raw], self.first[raw]), -1)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(ids), 0), np.int64)
        done = np.empty_like(ids)
        rows = np.arange(len(ids))
        while True:
            if not ranks.shape[1]:
                done[rows, : ids.shape[1]] = ids
                break
            j = ranks.argmin(1)
            best = ranks[np.arange(len(j)), j]
            over = best == _NO
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                done[rows[over], ids.shape[1] :] = -1
                rows, ids, ranks, j, best = rows[~over], ids[~over], ranks[~over], j[~over], best[~over]
                if not len(rows):
                    break
            here, k = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            shift = k + (k > j[:, None])
            new = np.take_along_axis(ids, shift, 1)
            new[here, j] = self.made[best]
            left = np.where(j > 0, self._ranks(new[here, np.maximum(j - 1, 0)], new[here, j]), _NO)
            right = np.where(j + 1 < new.shape[1], self._ranks(new[here, j], new[here, np.minimum(j + 1, new.shape[1] - 1)]), _NO)
            k = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, k + (k >= j[:, None]), 1)
            if ranks.shape[1]:
                has = j > 0
                ranks[here[has], j[has] - 1] = left[has]
                has = j < ranks.shape[1]
                ranks[here[has], j[has]] = right[has]
            tail = ids.shape[1] - 1
            done[rows, tail] = -1
            ids = new
        counts[block] = (done >= 0).sum(1)
        return done[done >= 0]
