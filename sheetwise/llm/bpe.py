"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols; leaf i of the tree holds the rank of the pair (symbol
i, next live symbol) and, in its lowest bits, i. An inner node holds the lesser of its
halves, so the root names the leftmost pair of lowest rank. A merge
changes two or three leaves, each repaired on the way to the root: a word of n
symbols takes O(n log n) steps however long it is. Words of up to `1 << DEPTH` symbols
grow their trees side by side, a merge of each word in one step over arrays.

Texts split at white space into pieces that never influence one another, so each
distinct piece is encoded once for a Python worker and looked up afterwards: some texts
at a time (`CHUNK` characters) first learn the pieces that are new. The table of pieces
is emptied when it reaches `CACHED_PIECES`, which bounds memory and changes no result.

Defined results: null and empty texts have no ids and decode to an empty text; very
long words are encoded whole; rows are independent, so repeated rows, ties and null
ids are kept as they come; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CACHED_PIECES = 400_000
#: Characters of the texts that learn their new pieces together (a longer text is one of them).
CHUNK = 1 << 19
#: Longer words than 1 << DEPTH symbols are merged one at a time.
DEPTH = 6
#: Above all ranks; small, so that short words have keys of one machine word.
_NONE = 1 << 24
#: Bits of a symbol's id in the key of a pair.
PAIR = 20
#: str.split() also splits at these four, which are no white space here.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def pieces(text: str) -> list[str]:
    """The parts of a text between white space."""
    if _SEPARATORS.search(text):
        return [p for p in _WHITE.split(text) if p]
    return text.split()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class PairTree:
    """The merges of one word, driven by a segment tree of pair ranks."""

    def __init__(self, ids: list[int], ranks: dict[int, int], merged: list[int]):
        """ranks: of a pair (a, b) at a << PAIR | b; merged: the symbol that each rank makes."""
        n = len(ids)
        depth = (n - 1).bit_length()
        self.ids, self.ranks, self.merged, self.depth = ids, ranks, merged, depth
        self.next, self.prev = [*range(1, n), -1], [-1, *range(n - 1)]
        found = ranks.get
        level = [found(a << PAIR | b, _NONE) << depth | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        level += [_NONE << depth] * ((1 << depth) - n + 1)
        tree = level
        while len(level) > 1:
            level = [a if a < b else b for a, b in zip(level[::2], level[1::2])]
            tree = level + tree
        self.tree = [0, *tree]

    def merge_all(self) -> list[int]:
        ids, tree, depth, following, previous = self.ids, self.tree, self.depth, self.next, self.prev
        found, merged, size, none = self.ranks.get, self.merged, 1 << self.depth, _NONE << self.depth
        while (low := tree[1]) < none:
            i = low & size - 1
            j = following[i]
            made = ids[i] = merged[low >> depth]
            after, before = following[j], previous[i]
            following[i] = after
            following[j] = -1
            rank = none
            if after >= 0:
                previous[after] = i
                rank = found(made << PAIR | ids[after], _NONE) << depth | i
            changed = ((j, none), (i, rank)) if before < 0 else ((j, none), (i, rank), (before, found(ids[before] << PAIR | made, _NONE) << depth | before))
            for k, low in changed:
                k += size
                if tree[k] == low:
                    continue
                tree[k] = low
                while k > 1:
                    a = tree[k ^ 1]
                    if a < low:
                        low = a
                    k >>= 1
                    if tree[k] == low:
                        break
                    tree[k] = low
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = following[i]
        return out


class PairTrees:
    """The merges of many words at once: trees like those of `PairTree`, one merge of every unfinished word a step."""

    def __init__(self, ranks: dict[int, int], merged: list[int]):
        keys = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.places = np.append(np.fromiter(ranks.values(), np.int64, len(ranks))[order], _NONE)
        self.merged = np.array(merged, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; a symbol of -1 has no pair."""
        pair = left << PAIR | right
        at = np.searchsorted(self.keys, pair)
        return np.where((self.keys[at] == pair) & (left >= 0), self.places[at], _NONE)

    def merge_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, ...]]:
        """The merged ids of words: rows of ids, as many as sizes says, of 1 << depth columns."""
        n, size = ids.shape
        depth, none = size.bit_length() - 1, _NONE << (size.bit_length() - 1)
        place, width = np.arange(size), size + 1
        # column `size` stands for what lies outside of a word
        ids = np.hstack([np.where(place < sizes[:, None], ids, -1), np.full((n, 1), -1)])
        tree = np.full((n, 2 * size), none)
        low = self.rank(ids[:, :-1], ids[:, 1:])
        tree[:, size:] = np.where(low < _NONE, low << depth | place, none)
        for k in (1 << d for d in range(depth - 1, -1, -1)):
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        following, previous = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, size), (n, 1))
        following[:, size] = size
        following[np.arange(n), sizes - 1] = size
        previous[:, 0] = size
        flat, tree, following, previous, row = ids.ravel(), tree.ravel(), following.ravel(), previous.ravel(), np.arange(n)
        while True:
            low = tree[row * (2 * size) + 1]
            row, low = row[low < none], low[low < none]
            if not len(row):
                break
            base, i = row * width, low & size - 1
            j = following[base + i]
            after, before = following[base + j], previous[base + i]
            made = flat[base + i] = self.merged[low >> depth]
            flat[base + j] = -1
            following[base + i], previous[base + after] = after, i
            right, left = self.rank(made, flat[base + after]), self.rank(flat[base + before], made)
            right = np.where((right < _NONE) & (after < size), right << depth | i, none)
            left = np.where(left < _NONE, left << depth | before, none)
            # a word without a symbol before sets its leaf i twice
            left, before = np.where(before < size, left, right), np.where(before < size, before, i)
            k = np.concatenate([j, i, before]) + size
            top = np.concatenate([row, row, row]) * (2 * size)
            tree[top + k] = np.concatenate([np.full(len(row), none), right, left])
            for _ in range(depth):
                k >>= 1
                under = top + 2 * k
                tree[top + k] = np.minimum(tree[under], tree[under + 1])
        live = ids[:, :-1] >= 0
        out, ends = ids[:, :-1][live].tolist(), live.sum(axis=1).cumsum().tolist()
        return [tuple(out[a:b]) for a, b in zip([0, *ends], ends)]


class WordBPE:
    """A lower-casing, byte-level word vocabulary with word ends, as its JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if max(self.tokens) >> PAIR or len(pairs) > _NONE:
            raise ValueError("the vocabulary is too large")
        self.ranks = {vocab[a] << PAIR | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        # what each token adds to the digested texts
        self.decimal, self.decoded = {i: b"%d " % i for i in self.tokens}, {i: f"{t} ".encode() for i, t in self.tokens.items()}
        symbols = byte_symbols()
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + suffix] for s in symbols]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.beginnings = sorted({s[:2] for s in self.special})
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.trees = PairTrees(self.ranks, self.merged)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            raw = word.encode("utf-8")
            ids = [self.inner[b] for b in raw]
            ids[-1] = self.last[raw[-1]]
            found = tuple(ids) if len(ids) == 1 else tuple(PairTree(ids, self.ranks, self.merged).merge_all())
            if len(self.words) >= CACHED_PIECES:
                self.words.clear()
            self.words[word] = found
        return found

    def parts(self, piece: str) -> list[str | int]:
        """The words and the ids of special tokens in a text without the white space that splits texts."""
        some = (piece,)
        for s in self.beginnings:  # only a text with the beginning of a special token is searched for one
            if s in piece:
                some = self.cut.split(piece)
                break
        out: list[str | int] = []
        for k, part in enumerate(some):
            if k % 2:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    # character by character there is no final sigma
                    part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
                low = part.lower()
                if low.isascii() and low.isalpha():  # one run of letters
                    out.append(low)
                else:
                    out += self.split.findall(low)
        return out

    def piece(self, piece: str) -> list[int]:
        """The ids of a text without the white space that splits texts."""
        out: list[int] = []
        for w in self.parts(piece):
            if isinstance(w, int):
                out.append(w)
            else:
                out += self.words.get(w) or self.word(w)
        return out

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of words, those of equal tree depth merged together."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = sizes.cumsum()
        codes = np.frombuffer(b"".join(raw), np.uint8)
        ids = np.array(self.inner)[codes]
        ids[ends - 1] = np.array(self.last)[codes[ends - 1]]
        out: list = [None] * len(raw)
        for depth in range(DEPTH + 1):
            at = np.flatnonzero((sizes <= 1 << depth) & (sizes > (1 << depth) // 2))
            if len(at):
                place = np.minimum((ends - sizes)[at, None] + np.arange(1 << depth), len(ids) - 1)
                for k, found in zip(at.tolist(), self.trees.merge_all(ids[place], sizes[at])):
                    out[k] = found
        for k in np.flatnonzero(sizes > 1 << DEPTH).tolist():
            out[k] = tuple(PairTree(ids[ends[k] - sizes[k] : ends[k]].tolist(), self.ranks, self.merged).merge_all())
        return out

    def learn(self, some: set[str]) -> None:
        """Puts pieces into the table: (count, decimal ids, decoded text), the latter two each followed by one space."""
        parts = [(p, self.parts(p)) for p in some]
        new = list({w for _, ws in parts for w in ws if isinstance(w, str)}.difference(self.words))
        if new:
            self.words.update(zip(new, self.merge(new)))
        words, decimal, decoded, table = self.words, self.decimal.__getitem__, self.decoded.__getitem__, self.pieces
        for p, ws in parts:
            ids = words[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else [i for w in ws for i in ((w,) if isinstance(w, int) else words[w])]
            table[p] = (len(ids), b"".join(map(decimal, ids)), b"".join(map(decoded, ids)))

    def encode(self, text: str) -> list[int]:
        return [i for p in pieces(text) for i in self.piece(p)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space; ids outside the vocabulary are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def digests(self, texts: Iterator[str]) -> Iterator[tuple[int, str, str]]:
        """(count of ids, digest of the decimal ids, digest of the decoded text) of each text."""
        held, size = [], 0
        for text in chain(texts, [None]):
            if text is not None:
                held.append(pieces(text))
                size += len(text)
            if size >= CHUNK or text is None:
                for known in (self.pieces, self.words):
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                self.learn({p for ps in held for p in ps if p not in self.pieces})
                for ps in held:
                    counts, ids, decoded = zip(*map(self.pieces.__getitem__, ps)) if ps else ((), (), ())
                    yield sum(counts), hashlib.sha256(b"".join(ids)[:-1]).hexdigest(), hashlib.sha256(b"".join(decoded)[:-1]).hexdigest()
                held, size = [], 0


_loaded: dict[str, WordBPE] = {}


def vocabulary(path: str) -> WordBPE:
    """One per Python process."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False, keep: bool = False) -> DataFrame:
    """Ids of every whole text.

    Columns: id, ids array<int> and decoded string; with digests_only their count
    and digests, which never hold a document's ids as Python numbers; with keep all
    input columns first and then ids, which takes the place of a column of that name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            if not digests_only:
                lists = [bpe.encode(t.as_py() or "") for t in texts]
                ids = pa.array(lists, pa.list_(pa.int32()))
                if keep:
                    yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([bpe.decode(x) for x in lists], pa.string())], [id_col, "ids", "decoded"])
                continue
            found = list(bpe.digests(t.as_py() or "" for t in texts))
            counts, ids_sha, text_sha = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    if keep:
        clash = [c for c in docs.columns if c.lower() == "ids"]
        rows = docs.drop(*clash)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{fields}, ids array<int>")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {more}")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows with an `ids` array column; null arrays decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x.as_py() or []) for x in b.column(1)], pa.string())], [id_col, "text"])

    return rows.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_vocabulary(), digests_only=True)
