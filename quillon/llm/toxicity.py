"""Toxicity by noisy-channel deobfuscation.

A word seen in a text is taken as a clean word sent through a noisy channel: letters replaced by look-alikes, marks put
between them, letters repeated, or the word parted by spaces. Its possible readings form a lattice, and a Viterbi search
under a character trigram model finds the likeliest. A word of letters, no two alike in a row, has one reading, itself. A
logistic model over the beginnings of the restored words then scores the text.

Which lattices are built: in training one for each distinct piece with a sign of the channel; in scoring only where some
reading can begin as a feature does, told by rough outlines (marks dropped, look-alikes read, repeats as one), since no other
reading can count. A word parted by spaces is looked for where a piece can be the beginning of a longer feature and the pieces after it can
go on with it; the lattice over the text from there on then says whether the spaces are dropped or part words. It takes as many
pieces as it needs, to the text's end if need be: until all surviving paths agree on the first word.

Corpus statistics: trigram counts of every clean word (letters only) of every text, over a fixed alphabet of 64 classes, so the
model has a fixed size while what is counted grows with the input. The classifier is fitted on ``TRAIN_ROWS`` labelled rows at
most, picked by hash; its features are those whose log-likelihood ratio against the label is significant over those rows.
The sample's ids are few enough to broadcast, so no text is shuffled. Scoring is one scan; a worker keeps the readings of
candidate pieces up to a bound. Time and memory grow in proportion to a word's length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import slices
from .shared import map_batches, read_table, whole

#: Labelled rows to fit on, features of the classifier at most, documents of label 1 and log-likelihood ratio a feature needs.
TRAIN_ROWS, FEATURES, MIN_DOCS, MIN_RATIO = 20_000, 600, 4, 16.0
#: Rows of this remainder of crc32(id) mod 4 never give labels.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Readings that a worker keeps between batches; beginnings of words that are features, by length, and letters of a word
#: that is a feature as a whole, at most.
KEPT_WORDS, PREFIXES, WHOLE = 100_000, (3, 4, 5, 6, 7, 8), 32
#: Pieces that a run is first read with, more as needed, and characters of a run whose reading is kept; letters of a beginning
#: that counts where spaces were dropped.
RUN, KEPT_RUN, PARTED = 3, 256, 5
#: Bytes of text worked on at once.
SLICE_BYTES = 4_000_000

# Characters that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "µ": "u", "*": "aeiou",
}
#: Costs, as negative logarithms, of a look-alike, a dropped mark, a dropped space and a repeated letter. A run of equal
#: characters costs as much at any length, and more than ``ALIKE`` of them read as so many.
SUBSTITUTE, DROP, JOIN, REPEAT, ALIKE = 1.5, 2.0, 3.0, 0.7, 4
#: Between two single characters a space is mostly the channel's: costs of dropping it, and of a true one.
JOIN_SINGLE, PART_SINGLE = 0.1, 4.0

# The trigram model's alphabet. Class 0 is a word's edge, 1 any digit, 2 any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
CLASSES = 64


def _class_table() -> np.ndarray:
    table = np.full(0x250, 2, np.int64)
    table[ord("0") : ord("9") + 1] = 1
    for k, c in enumerate(LETTERS):
        table[ord(c)] = 3 + k
        if len(c.upper()) == 1 and ord(c.upper()) < 0x250:
            table[ord(c.upper())] = 3 + k
    table[0x20] = 0
    return table


_CLASS = _class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], 2)


def trigram_counts(pieces: list[str], counts: np.ndarray) -> np.ndarray:
    """Weighted counts of three successive classes; a word has two edges before it and one after."""
    c = classes_of("  " + "  ".join(pieces) + " ")
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    owner = np.repeat(np.arange(len(pieces)), lens + 1)
    third = np.arange(len(owner)) + owner + 2
    return np.bincount(c[third - 2] * CLASSES * CLASSES + c[third - 1] * CLASSES + c[third], weights=counts[owner], minlength=CLASSES**3)


class CharacterModel:
    """Trigram model with the smoothed bigram and unigram below it, as a table of negative logarithms."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        one = n.sum((0, 1)) + 1
        one /= one.sum()
        two = n.sum(0)
        two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
        three = (n + 20 * two) / (n.sum(2, keepdims=True) + 20)
        c = (-np.log(three)).astype(np.float32)
        self.cost = c.ravel().tolist()
        # what two letters may cost more after a word's edge than after other letters; from the third on they cost the same
        self.apart = (c[0, 0] - c + (c[0] - c).max(2))[:, :, 1:].max().item() + 1e-3

    def _paths(self, low: str, end: int, number: int, first: bool = False) -> dict[int, tuple]:
        """The best paths through the lattice of the first ``end`` characters, by their last two classes: cost, text, and the
        first word with the spaces it took in once a space has ended it. ``first``: until all agree on the first word.

        Each character is read as itself or as a letter it looks like; a mark may be dropped; a character like the one
        before may be taken as the same letter; a space parts words or is dropped. A number at the end, from ``number`` on,
        may be dropped as one mark.
        """
        cost = self.cost
        # states: class before last * CLASSES + last class -> (cost, text so far as a linked list, first word)
        states: dict[int, tuple] = {0: (0.0, None, None)}
        before, cut, spaces = "", {}, 0
        for i in range(end):
            x, new = low[i], {}
            if i == number:
                cut = {s: (v + DROP, t, w) for s, (v, t, w) in states.items()}
            if x == " ":
                single = low[i - 2 : i - 1] in ("", " ") and low[i + 2 : i + 3] in ("", " ")
                join, part = (JOIN_SINGLE, PART_SINGLE) if single else (JOIN, 0.0)
                for s, (v, t, w) in states.items():
                    if not s:  # a piece dropped as a whole begins no word
                        value = v, t, w or (t, spaces)
                    else:
                        value = v + cost[s * CLASSES] + part, (t, " "), w or (t, spaces)
                        if s not in new or v + join < new[s][0]:
                            new[s] = v + join, t, w
                    if 0 not in new or value[0] < new[0][0]:
                        new[0] = value
                if first:  # paths that the one with this space parting words beats, whatever follows
                    new = {s: p for s, p in new.items() if p[0] <= new[0][0] + self.apart}
                spaces += 1
            else:
                reads = _READS.get(x) or _reads(x)
                same = x == before
                # a run of equal marks is dropped as one
                drop = None if x.isalnum() else 0.0 if same else DROP
                for s, (v, t, w) in states.items():
                    b, base = s % CLASSES, s * CLASSES
                    for y, c, price in reads:
                        value, to = v + price + cost[base + c], b * CLASSES + c
                        if to not in new or value < new[to][0]:
                            new[to] = value, (t, y), w
                        if same and c == b and (s not in new or v + REPEAT < new[s][0]):
                            new[s] = v + (REPEAT if low[i - 2 : i - 1] != x else 0.0), t, w
                    if drop is not None and (s not in new or v + drop < new[s][0]):
                        new[s] = v + drop, t, w
            states, before = new, x
            if first and spaces and not cut:
                w = next(iter(states.values()))[2]
                if w and all(p[2] is w for p in states.values()):
                    return states
        for s, found in cut.items():
            if s not in states or found[0] < states[s][0]:
                states[s] = found
        return states

    def _best(self, states: dict[int, tuple], more: bool) -> tuple:
        return min(((v if more or not s else v + self.cost[s * CLASSES], t, w) for s, (v, t, w) in states.items()), key=lambda p: p[0])

    def decode(self, seen: str, more: bool = False) -> tuple[float, str]:
        """The cost and the text of the likeliest reading: the best path through the lattice of ``seen``. With ``more`` the
        last word may go on after the end."""
        low = _reduced(seen)
        value, text, _ = self._best(self._paths(low, len(low), _number(low)), more)
        return value, _spelled(text)

    def first_words(self, low: str, more: bool) -> list[tuple[str, int, bool]]:
        """What the first word of the likeliest reading may be: its text, the spaces it took in, whether it has ended. With
        ``more``, other pieces follow the space at the end of ``low``, and each surviving path may turn out the likeliest."""
        end = len(low) - more
        states = self._paths(low, end, -1 if more else _number(low), True)
        paths = states.values() if more else [self._best(states, False)]
        words = {id(w or t): (w or (t, low.count(" ", 0, end)), w is not None or not more) for _, t, w in paths}
        return [(_spelled(t), n, ended) for (t, n), ended in words.values()]

    def restore(self, seen: str, more: bool = False) -> str:
        return self.decode(seen, more)[1]


#: Readings of a character: (letter, class, cost).
_READS: dict[str, list[tuple[str, int, float]]] = {}


def _reads(x: str) -> list[tuple[str, int, float]]:
    if len(_READS) > 10_000:
        _READS.clear()
    _READS[x] = [(x, classes_of(x)[0].item(), 0.0), *((y, classes_of(y)[0].item(), SUBSTITUTE) for y in LOOKALIKES.get(x, ""))]
    return _READS[x]


def _spelled(text: tuple | None) -> str:
    out = []
    while text:
        text, y = text
        out.append(y)
    return "".join(reversed(out))


def _number(low: str) -> int:
    number = _NUMBER.search(low)
    return number.start() if number else -1


def _reduced(seen: str) -> str:
    """Lower case, with single spaces and runs of equal characters no longer than ``ALIKE``."""
    low = seen.lower()
    low = _SPACES.sub(" ", low if len(low) == len(seen) else seen)
    return _LONG_RUN.sub(lambda m: m[1] * ALIKE, low)


_SPACES, _LONG_RUN = re.compile(r" {2,}"), re.compile(rf"(.)\1{{{ALIKE},}}", re.DOTALL)
#: A sign of the channel: anything but letters, or a letter twice in a row.
_NOISY = re.compile(r"[^\w]|[\d_]|([^\W\d_])\1", re.IGNORECASE)
_CLEAN = r"\A\p{L}+[.,;:!?]*\z"
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Marks at the end that stand for no letter; a number at the end.
_TRAIL = re.compile(r"[^\w$@!|+(€£¥§*]+$")
_NUMBER = re.compile(r"(?<=[^\W\d_]{3})\d{3,}$")


class Restorer:
    def __init__(self, model: CharacterModel):
        self.model = model

    def word(self, seen: str) -> str:
        """The clean lower-case word; letters without signs of the channel are themselves."""
        word = _TRAIL.sub("", seen)
        if _NOISY.search(word):
            word = self.model.restore(word)
        return _EDGES.sub("", word).lower()

    def parted(self, pieces: list[str], more: bool) -> tuple[str, int] | None:
        """The first word of pieces with spaces between them, and how many spaces it took in. With ``more``, others follow;
        None where these decide. A word over ``WHOLE`` letters may come without its end, which is no part of a feature."""
        if not more:
            pieces = _TRAIL.sub("", " ".join(pieces)).split(" ")
        low = " ".join(map(_reduced, pieces)) + " " * more
        words = [(_EDGES.sub("", word).lower(), n, ended) for word, n, ended in self.model.first_words(low, more)]
        if any(not ended and len(word) <= WHOLE for word, _, ended in words) or len({(*features_of(word), n > 0) for word, n, _ in words}) > 1:
            return None
        return words[0][:2]


def features_of(word: str) -> list[str]:
    """A word's beginnings, and the word."""
    if len(word) < PREFIXES[0]:
        return []
    return [word[:k] for k in PREFIXES if k < len(word)] + [word + "$"] * (len(word) <= WHOLE)


def _fold_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point under 0x250: what it counts as where readings are told apart roughly (0: dropped), whether it may be read
    or dropped, and whether it is a letter. Letters that share a look-alike count as one."""
    letters = {y for ys in LOOKALIKES.values() for y in ys}
    same = {y: min(next((ys for ys in LOOKALIKES.values() if y in ys and 1 < len(ys) < 5), y)) for y in letters}
    fold, either, letter = (np.zeros(0x250, t) for t in (np.uint32, bool, bool))
    for k in range(0x250):
        c = chr(k)
        letter[k] = c.isalpha()
        if c in LOOKALIKES:
            fold[k], either[k] = ord(same[min(LOOKALIKES[c])]), not c.isdigit()
        elif c.isalnum():
            fold[k] = ord(same.get(c, c))
    return fold, either, letter


_FOLD, _EITHER, _LETTER = _fold_tables()
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Outlines:
    """Rough readings of strings: marks dropped, look-alikes read, repeats taken as one. String i's are ``size[i]`` letters in
    ``fold`` from ``start[i]`` on; from the ``odd[i]``-th on it has more than one such reading."""

    def __init__(self, strings: pa.Array):
        low = pc.utf8_lower(strings)
        n = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
        self.strings, m = strings, len(n)
        points = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        owner, place = np.repeat(np.arange(m, dtype=np.int32), n), np.minimum(points, 0x24F)
        plain = points < 0x250
        fold = np.where(plain, _FOLD[place], points)
        either, letter = plain & _EITHER[place], ~plain | _LETTER[place]
        for c in LOOKALIKES:
            if ord(c) >= 0x250:
                at = points == ord(c)
                fold[at], either[at], letter[at] = _FOLD[ord(LOOKALIKES[c][0])], True, False
        letters = np.cumsum(letter, dtype=np.int32)
        before = np.append(np.int32(0), letters)[np.cumsum(n) - n]
        either |= (letters == before[owner]) & ~letter  # a number ahead of the letters may be read or cut off
        keep = fold > 0
        fold, owner, either = fold[keep], owner[keep], either[keep]
        again = np.append(False, (fold[1:] == fold[:-1]) & (owner[1:] == owner[:-1])) if len(fold) else np.zeros(0, bool)
        odd, self.fold, owner = np.unique(owner[either & again]), fold[~again], owner[~again]
        self.size = np.bincount(owner, minlength=m)
        self.start = np.cumsum(self.size) - self.size
        self.odd = np.full(m, np.iinfo(np.int64).max)
        at = np.flatnonzero(either[~again])
        of, first = np.unique(owner[at], return_index=True)
        self.odd[of] = at[first] - self.start[of]
        self.odd[odd] = 0

    def keys(self, depth: int, among=None):
        """For k from 0 to ``depth``: the strings of more than k letters and keys that tell their first k + 1. ``among(k, keys)``:
        those that go on after k."""
        at, key = np.arange(len(self.size)), np.zeros(len(self.size), np.uint64)
        for k in range(depth):
            longer = self.size[at] > k
            at = at[longer]
            key = (key[longer] + self.fold[self.start[at] + k]) * _MIX
            key ^= key >> np.uint64(29)
            if among:
                on = among(k, key)
                at, key = at[on], key[on]
            yield k, at, key


class Gate:
    """Tells strings of which some reading begins with one of the targets, or is a part of one that goes on after it. It may
    let others through."""

    def __init__(self, targets: list[str]):
        self.trie: dict = {}
        for t in targets:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = {}
        wholes, parts = Outlines(pa.array(targets, pa.string())), Outlines(pa.array(sorted({t[:k] for t in targets for k in range(1, len(t))}), pa.string()))
        self.depth = int(wholes.size.max(initial=0))
        self.whole = [np.unique(key[wholes.size[at] == k + 1]) for k, at, key in wholes.keys(self.depth)]
        self.part = [np.unique(key[parts.size[at] == k + 1]) for k, at, key in parts.keys(self.depth)]
        self.begun = [np.unique(key) for _, _, key in wholes.keys(self.depth)]

    def walk(self, nodes: list[dict], seen: str) -> tuple[list[dict], bool]:
        """The nodes of the trie that readings of a piece may lead to, and whether one of them comes by the end of a target."""
        before, reached = "", False
        for x in _reduced(seen):
            new = {}
            for node in nodes:
                if not x.isalnum() or x == before or (node is self.trie and not x.isalpha()):
                    new[id(node)] = node
                for y in (x, *LOOKALIKES.get(x, "")):
                    if y in node:
                        new[id(node[y])] = node[y]
                        reached = reached or "" in node[y]
            nodes, before = list(new.values()), x
            if not nodes:
                break
        return nodes, reached

    def inside(self, nodes: list[dict]) -> list[dict]:
        """Those of the nodes at which a target has begun and goes on."""
        return [node for node in nodes if node is not self.trie and len(node) > ("" in node)]

    def test(self, o: Outlines) -> tuple[np.ndarray, np.ndarray]:
        """(reached, part): whether some reading begins with a target; whether one is a part of a longer target."""
        reached, part = np.zeros(len(o.size), bool), np.zeros(len(o.size), bool)
        for k, at, key in o.keys(self.depth, lambda k, key: np.isin(key, self.begun[k])):
            reached[at[np.isin(key, self.whole[k])]] = True
            part[at[(o.size[at] == k + 1) & np.isin(key, self.part[k])]] = True
        odd = np.flatnonzero(o.odd < self.depth)
        for i, seen in zip(odd.tolist(), o.strings.take(pa.array(odd)).to_pylist(), strict=True):
            nodes, reached[i] = self.walk([self.trie], seen)
            part[i] = bool(self.inside(nodes))
        return reached, part


class Words:
    """The features of Arrow texts: of their restored pieces, and of words that spaces part."""

    def __init__(self, restorer: Restorer, known: dict[str, int] | None = None):
        self.restorer, self.known = restorer, known
        self.of_piece: dict[str, tuple] = {}
        self.of_run: dict[tuple, tuple] = {}
        if known is not None:
            self.start = Gate(sorted({f.rstrip("$")[:PARTED] for f in known}))
            # what spaces may part: whole words, and beginnings of PARTED letters
            self.parts = Gate(sorted({f.rstrip("$") for f in known if f.endswith("$") or len(f) >= PARTED}))

    def _kept(self, of: dict, key, make) -> tuple:
        if key not in of:
            if len(of) > KEPT_WORDS:
                of.clear()
            of[key] = make(key)
        return of[key]

    def _piece(self, seen: str) -> tuple:
        return self._known(features_of(self.restorer.word(seen)))

    def _known(self, features: list[str]) -> tuple:
        return tuple(features) if self.known is None else tuple(self.known[f] for f in features if f in self.known)

    def _run(self, key: tuple) -> tuple | None:
        """The features of the word that a run of pieces starts with, where it took in the space after the first; None where
        the pieces after the run decide."""
        *pieces, more = key
        found = self.restorer.parted(pieces, more)
        if not found or not found[1]:
            return found and ()
        first = len(self.restorer.word(pieces[0]))
        return self._known([f for f in features_of(found[0]) if f.endswith("$") or len(f) >= max(PARTED, first)])

    def texts(self, texts: pa.Array) -> list[set]:
        """The features of each text."""
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        out: list[set] = [set() for _ in range(len(texts))]
        if not len(flat):
            return out
        unique, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        asked = np.arange(len(unique))
        if self.known is not None:
            outlines = Outlines(unique)
            asked = np.flatnonzero(self.start.test(outlines)[0])
        values: dict[int, tuple] = {}
        for c, seen in zip(asked.tolist(), unique.take(pa.array(asked)).to_pylist(), strict=True):
            if found := self._kept(self.of_piece, seen, self._piece):
                values[c] = found
        full = np.zeros(len(unique), bool)
        full[list(values)] = True
        hits = np.flatnonzero(full[codes])
        pairs = np.unique((np.searchsorted(offsets, hits, "right") - 1) * len(unique) + codes[hits])
        for o, c in zip((pairs // len(unique)).tolist(), (pairs % len(unique)).tolist(), strict=True):
            out[o].update(values[c])
        if self.known is not None:
            self._parted(unique, codes, offsets, self.parts.test(outlines)[1], out)
        return out

    def _parted(self, unique: pa.Array, codes: np.ndarray, offsets: np.ndarray, head: np.ndarray, out: list[set]) -> None:
        """Adds the features of words that spaces part; ``head``: which pieces may begin one and be less than it."""
        codes, offsets = _fewer_marks(unique, codes, offsets)
        full = pc.greater(pc.binary_length(unique), 0).to_numpy(zero_copy_only=False)
        last = np.zeros(len(codes), bool)
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        at = np.flatnonzero(head[codes] & ~last)
        at = at[full[codes[at + 1]]]
        pairs, which = np.unique(codes[at] * len(unique) + codes[at + 1], return_inverse=True)
        if not len(pairs):
            return
        joined = pc.binary_join_element_wise(unique.take(pa.array(pairs // len(unique))), unique.take(pa.array(pairs % len(unique))), "")
        reached, part = self.parts.test(Outlines(joined))
        at = at[(reached | part)[which]]
        owner = np.searchsorted(offsets, at, "right") - 1
        # the piece after a text's last white space is empty
        ends = offsets[owner + 1] - ~full[codes[offsets[owner + 1] - 1]]
        seen, walked = unique.to_pylist(), ({}, {})
        for a, end, o in zip(at.tolist(), ends.tolist(), owner.tolist(), strict=True):
            if self._goes_on(seen, codes, a, end, walked):
                out[o].update(self._word_from(seen, codes, a, end))

    def _goes_on(self, seen: list[str], codes: np.ndarray, a: int, end: int, walked: tuple[dict, dict]) -> bool:
        """Whether some reading of the pieces from ``a`` on comes by the end of a target after the first piece. Each piece with a
        letter takes a step in the trie, so few are looked at. ``walked``: what two pieces lead to, what nodes at a place do."""
        pairs, places = walked
        pair, trail = (codes[a].item(), codes[a + 1].item()), []
        if pair not in pairs:
            nodes = self.parts.inside(self.parts.walk([self.parts.trie], seen[pair[0]])[0])
            pairs[pair] = self.parts.walk(nodes, seen[pair[1]])
        (nodes, reached), a = pairs[pair], a + 2
        while not reached and nodes and a < end:
            trail.append((a, *sorted(map(id, nodes))))
            if trail[-1] in places:
                reached = places[trail[-1]]
                break
            nodes, reached = self.parts.walk(nodes, seen[codes[a]])
            a += 1
        places.update(dict.fromkeys(trail, reached))
        return reached

    def _word_from(self, seen: list[str], codes: np.ndarray, a: int, end: int) -> tuple:
        """The features of the word that the pieces from ``a`` on start with, read with as many pieces as decide it."""
        size, found = RUN, None
        while found is None:
            pieces = [seen[c] for c in codes[a : min(a + size, end)].tolist()]
            key, size = (*pieces, a + size < end), 2 * size
            found = self._kept(self.of_run, key, self._run) if sum(map(len, pieces)) <= KEPT_RUN else self._run(key)
        return found


def _fewer_marks(unique: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (codes) of texts (offsets) in which no more than ``ALIKE`` equal pieces of marks alone follow one another: as within
    a piece, a longer run reads as so many."""
    marks = pc.match_substring_regex(unique, r"\A[^\p{L}\p{N}]+\z").to_numpy(zero_copy_only=False)
    place = np.arange(len(codes))
    begins = np.append(True, (codes[1:] != codes[:-1]) | ~marks[codes[1:]])
    begins[offsets[:-1][offsets[:-1] < len(codes)]] = True
    keep = place - np.maximum.accumulate(np.where(begins, place, 0)) < ALIKE
    return codes[keep], np.append(0, np.cumsum(keep))[offsets]


def corpus_trigrams(df: DataFrame) -> np.ndarray:
    """Trigram counts of the clean words of all texts; the driver gets one number per trigram of classes at most."""

    def run(batches):
        total = np.zeros(CLASSES**3)
        for batch in slices(batches, text=0, limit=SLICE_BYTES):
            counts = pc.ascii_split_whitespace(batch.column(0)).flatten().value_counts()
            # clean words only: what a noisy channel's source may say
            counts = counts.filter(pc.match_substring_regex(counts.field(0), _CLEAN))
            total += trigram_counts(pc.utf8_rtrim(counts.field(0), ".,;:!?").to_pylist(), counts.field(1).to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], names=["gram", "n"])

    out = np.zeros(CLASSES**3)
    for r in map_batches(df.select("text"), "toxicity", run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    return out


def _logistic(rows: list[list[int]], labels: np.ndarray, n: int) -> np.ndarray:
    """Weights, the last of them the bias, by damped Newton steps on the ridge-penalised likelihood."""
    size = np.array([len(r) for r in rows])
    at, owner = np.array([i for r in rows for i in r], np.int64), np.repeat(np.arange(len(rows)), size)
    w, step = np.zeros(n + 1), np.zeros(n + 1)
    rate = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    w[n] = rate
    for k in range(300):
        z = np.bincount(owner, w[at], len(rows)) + w[n]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, h = p - labels, np.maximum(p * (1 - p), 1e-3)
        grad = np.append(np.bincount(at, g[owner], n) + 0.3 * w[:n], g.sum())
        curve = np.append(np.bincount(at, (h * np.maximum(size, 1))[owner], n) + 0.3, (h * np.maximum(size, 1)).sum() + 1)
        step = 0.7 * step + grad / curve
        w -= 0.5 * step
    return w


def likelihood_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """Twice the log-likelihood ratio of a feature in a of n_a and b of n_b documents; 0 where it isn't more frequent in the first."""
    if a * n_b <= b * n_a:
        return 0.0
    p = (a + b) / (n_a + n_b)
    cells = ((a, n_a * p), (b, n_b * p), (n_a - a, n_a * (1 - p)), (n_b - b, n_b * (1 - p)))
    return 2 * sum(o * np.log(o / e) for o, e in cells if o > 0)


class Scorer:
    """What workers need: the character model's table, the features and their weights."""

    def __init__(self, counts: np.ndarray, features: dict[str, int], weights: np.ndarray):
        self.counts, self.features, self.weights = counts, features, weights

    def words(self) -> Words:
        return Words(Restorer(CharacterModel(self.counts)), self.features)

    def score(self, found: set) -> float:
        z = self.weights[-1] + sum(self.weights[i] for i in found)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Scorer:
    """Fits on rows of ``docs`` (doc_id, text) that have a label (doc_id, toxic), outside the held-out fold.

    Null ids and null labels give no row; of several labels of an id the largest counts. Without rows of both labels the
    scorer gives every text the rate of label 1, 0 where there is none.
    """
    spark = docs.sparkSession
    counts = corpus_trigrams(docs)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != HELD_OUT))
    marked = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # a slice of the hashes' range that holds a little less than the bound; all rows where they are fewer
    share = min(1.0, 0.95 * train_rows / max(1, marked.count()))
    in_slice = (F.xxhash64("doc_id") % (1 << 20) + (1 << 20)) % (1 << 20) < int(share * (1 << 20))
    picked = marked.filter(in_slice).select(F.col("doc_id").alias("l_doc_id"), "toxic").limit(train_rows).collect()
    small = spark.createDataFrame(picked, f"l_doc_id {labels.schema['doc_id'].dataType.simpleString()}, toxic int")
    train = docs.join(F.broadcast(small), docs.doc_id == small.l_doc_id).select("toxic", "text")
    table = spark.sparkContext.broadcast((counts, None))

    def count(batches):
        words, seen = Words(Restorer(CharacterModel(table.value[0]))), {}
        wanted = table.value[1]
        for batch in slices(batches, text=0, limit=SLICE_BYTES):
            for found in words.texts(batch.column(0)):
                for f in found if wanted is None else found & wanted:
                    seen[f] = seen.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], names=["f", "n"])

    total = train.groupBy("toxic").count().collect()
    n_toxic, n = sum(r["count"] for r in total if r.toxic > 0), sum(r["count"] for r in total)
    if not 0 < n_toxic < n:
        z = -30.0 if not n_toxic else 30.0
        return Scorer(counts, {}, np.array([z]))

    def counted(rows: DataFrame, least: int) -> dict[str, int]:
        per = map_batches(rows.select("text"), "toxicity", count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
        return {r.f: r.n for r in per.filter(F.col("n") >= least).collect()}

    # documents of label 1 name the candidates; only these are counted in the others
    toxic = counted(train.filter("toxic > 0"), MIN_DOCS)
    table = spark.sparkContext.broadcast((counts, set(toxic)))
    clean = counted(train.filter("toxic <= 0"), 1)
    ratio = {f: likelihood_ratio(k, clean.get(f, 0), n_toxic, n - n_toxic) for f, k in toxic.items()}
    top = sorted((f for f in ratio if ratio[f] >= MIN_RATIO), key=lambda f: (-ratio[f], f))[:features]
    index = {f: i for i, f in enumerate(top)}

    def gather(batches):
        words = Words(Restorer(CharacterModel(table.value[0])), index)
        for batch in slices(batches, limit=SLICE_BYTES):
            found = [sorted(x) for x in words.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    rows = map_batches(train, "toxicity", gather, "toxic int, found array<int>").collect()  # TRAIN_ROWS at most
    weights = _logistic([r.found for r in rows], np.array([float(r.toxic > 0) for r in rows]), len(index))
    return Scorer(counts, index, weights)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    shared, id_type = docs.sparkSession.sparkContext.broadcast(scorer), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = shared.value.words()
        for batch in slices(batches, limit=SLICE_BYTES):
            scores = [shared.value.score(x) for x in words.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = map_batches(docs.select("doc_id", "text"), "toxicity", run, f"doc_id {id_type}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Scores every row's whole text: doc_id, held_out, score, predicted.

    A null text is empty; an empty text gets the score of a text without any feature. Rows with a null id are scored, not
    held out and not learnt from; repeated rows are scored alike. An empty table gives no rows. Labels, language, source
    and id take no part in a score. Other columns are ignored, whatever their names.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"))
    marks = labels.select(F.col("doc_id"), F.col(f"`{label_col}`").alias("toxic"))
    return score(docs, fit(docs, marks))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
