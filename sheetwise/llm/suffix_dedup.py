"""Removal of repeated 50-byte strings by a distributed merge sort of suffixes.

A byte goes if some 50-byte string over it also starts in a document with a smaller
id. Not every suffix has to be sorted for that: among the 20-byte strings inside a
50-byte window, the one of least hash (leftmost, if tied) is the window's anchor, and
equal windows have their anchors at the same place. Consecutive windows share
anchors, so one suffix in some sixteen, cut to what its windows cover, decides all.

1. Documents are dealt into blocks. Each block sends the sorted hashes of its anchors
   to buckets; a bucket answers with a bitmap of those seen in two documents or more.
   This is the distinguishing-prefix step of distributed string sorting: all other
   suffixes differ from every other one within 20 bytes.
2. Each block sorts the remaining suffixes (anchor to the right end of its windows,
   then the bytes before the anchor backwards), merges equal ones and sends the run
   to the buckets front-coded: a prefix length shared with the suffix before it, and
   the rest.
3. A bucket merges its runs with a loser tree that keeps, for every loser, the length
   of the prefix it shares with the winner. A match compares these lengths first and
   bytes only beyond them. The merged order brings equal anchors together; suffixes
   that are equal throughout are settled at once, and the others window by window.
4. Blocks get back byte ranges and cut them out of the texts.

Hashes choose anchors and buckets; whether two windows are equal is decided on bytes.
Each group is a block or a bucket, both as large as the number of shuffle partitions
makes them.

Defined results: a null or empty text has no bytes and loses none; a null id counts
as smaller than all others; rows with the same id never remove bytes from one
another; repeated rows give repeated results; texts shorter than 50 bytes stay
whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table
from .textscan import eights, slices

WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1
#: A suffix row: WIDTH bytes from the anchor on, SPAN - 1 bytes before it backwards, and the two lengths plus one.
ROW = WIDTH + SPAN - 1 + 2
HASH_BITS = 40
#: Of a gram's hash, that many low bits give way to its place when windows choose their anchors.
POSITION_BITS = 32
#: Bytes scanned at once: the arrays over them then fit into a core's cache.
SLICE = 1 << 18
_U = np.uint64


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash) of all runs of windows that share an anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none.astype(np.uint64)
    # eight bytes thrice, the last two overlapping: GRAM bytes
    view, grams = eights(data), n - GRAM + 1
    h = view[:grams] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h += view[8 : grams + 8]
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h += view[GRAM - 8 : grams + GRAM - 8]
    h *= _U(0x9FB21C651E98DF25)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    # the same bits in every slice, so that equal windows compare alike; of equal ones the leftmost counts
    low = h >> _U(POSITION_BITS)
    low <<= _U(POSITION_BITS)
    low |= np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if SPAN > size:
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    last = np.append(first[1:], len(low)) - 1
    p = (low[first] & _U((1 << POSITION_BITS) - 1)).astype(np.int64)
    # only windows inside the document of their anchor count
    owner = np.searchsorted(bounds, p, side="right") - 1
    first, last = np.maximum(first, bounds[owner]), np.minimum(last, bounds[owner + 1] - WIDTH)
    ok = first <= last
    p = p[ok]
    return p, first[ok], last[ok], h[p] >> _U(64 - HASH_BITS)


def grouped(f):
    def run(key, t):
        out = f(key, t)
        give_back()
        return out

    return run


def paired(f):
    def run(key, t, more):
        out = f(key, t, more)
        give_back()
        return out

    return run


class Block:
    """The rows of a block in an order that depends on their contents only."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("id", "ascending"), ("tie", "ascending")])
        self.ids = t["id"].to_numpy()
        self.missing = t["missing"]
        self.texts = t["text"].combine_chunks()

    def anchors(self) -> Iterator[tuple]:
        """(first row, bytes, bounds, anchors as above) of each slice."""
        for lo, _, data, bounds in slices(self.texts, SLICE):
            yield lo, data, bounds, anchors(data, bounds)

    def shared_locally(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, and whether two documents of the block have them."""
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[start], (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)) if len(start) else np.zeros(0, bool)


def bucket_edges(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` ranges of hash space begins in sorted hashes."""
    limits = (np.arange(parts + 1, dtype=object) * (1 << HASH_BITS) // parts).astype(np.uint64)
    return np.searchsorted(h, limits)


def pack_hashes(h: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences in bytes of 7 bits, then one bit each of flags."""
    d = np.diff(h, prepend=_U(0))
    width = np.maximum(1, (HASH_BITS - 6 + 6) // 7)
    out = np.zeros((len(d), int(width) + 1), np.uint8)
    size = np.ones(len(d), np.int64)
    for k in range(out.shape[1]):
        part = (d >> _U(7 * k)) & _U(0x7F)
        more = (d >> _U(7 * (k + 1))) > 0
        out[:, k] = part | (more.astype(np.uint8) << 7)
        size += more
    keep = np.arange(out.shape[1])[None, :] < size[:, None]
    return len(d).to_bytes(4, "little") + np.packbits(flags).tobytes() + out[keep].tobytes()


def unpack_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    k = 4 + (n + 7) // 8
    flags = np.unpackbits(np.frombuffer(raw[4:k], np.uint8), count=n).astype(bool)
    b = np.frombuffer(raw[k:], np.uint8)
    last = np.flatnonzero(b < 0x80)
    first = np.concatenate([[0], last[:-1] + 1])
    d = np.zeros(n, np.uint64)
    for j in range(int((last - first).max()) + 1 if n else 0):
        at = first + j
        ok = at <= last
        d[ok] |= (b[at[ok]] & np.uint8(0x7F)).astype(np.uint64) << _U(7 * j)
    return np.cumsum(d, dtype=np.uint64), flags


def send_hashes(parts: int):
    def run(key, t):
        block, rows = Block(t), []
        hs, ids = [], []
        for lo, _, bounds, (p, first, _, h) in block.anchors():
            hs.append(h)
            ids.append(block.ids[lo + np.searchsorted(bounds, first, side="right") - 1])
        if hs:
            h, twice = block.shared_locally(np.concatenate(hs), np.concatenate(ids))
            edge = bucket_edges(h, parts)
            rows = [{"block": key[0].as_py(), "bucket": b, "run": pack_hashes(h[edge[b] : edge[b + 1]], twice[edge[b] : edge[b + 1]])} for b in range(parts) if edge[b] < edge[b + 1]]
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("run", pa.binary())]))

    return run


def mark_shared(key, t):
    """For each run of a bucket, a bitmap of its hashes that occur in two documents."""
    runs = [unpack_hashes(r) for r in t["run"].to_pylist()]
    every = np.concatenate([h for h, _ in runs])
    value, n = np.unique(every, return_counts=True)
    shared = n > 1
    for h, flags in runs:
        shared[np.searchsorted(value, h[flags])] = True
    bits = [np.packbits(shared[np.searchsorted(value, h)]).tobytes() for h, _ in runs]
    return pa.table({"block": t["block"], "bucket": t["bucket"], "run": pa.array(bits, pa.binary())})


def front_code(rows: np.ndarray) -> bytes:
    """Sorted distinct suffix rows as shared prefix lengths and remainders."""
    n = len(rows)
    same = np.zeros((n, ROW), bool)
    same[1:] = rows[1:] == rows[:-1]
    prefix = np.where(same.all(axis=1), ROW, np.argmin(same, axis=1)).astype(np.uint8)
    return n.to_bytes(4, "little") + prefix.tobytes() + rows[np.arange(ROW)[None, :] >= prefix[:, None]].tobytes()


def decode_run(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """(suffix row, prefix shared with the one before)."""
    n = int.from_bytes(raw[:4], "little")
    prefixes, at, row = raw[4 : 4 + n], 4 + n, b""
    for k in prefixes:
        row = row[:k] + raw[at : at + ROW - k]
        at += ROW - k
        yield row, k


def send_suffixes(parts: int):
    def run(key, t, marks):
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("run", pa.binary()), ("places", pa.binary())])
        if not t.num_rows or not marks.num_rows:
            return schema.empty_table()
        block = Block(t)
        got = list(block.anchors())
        every = np.unique(np.concatenate([a[3] for _, _, _, a in got]))
        edge = bucket_edges(every, parts)
        shared = np.zeros(len(every), bool)
        for b, bits in zip(marks["bucket"].to_pylist(), marks["run"].to_pylist()):
            n = edge[b + 1] - edge[b]
            shared[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        rows, place, hashes = [], [], []
        for lo, data, bounds, (p, first, last, h) in got:
            keep = shared[np.searchsorted(every, h)]
            p, first, last = p[keep], first[keep], last[keep]
            m = np.zeros((len(p), ROW), np.uint8)
            right, left = last + WIDTH - p, p - first
            cols = np.arange(WIDTH)
            at = np.minimum(p[:, None] + cols, len(data) - 1)
            m[:, :WIDTH] = np.where(cols < right[:, None], data[at], 0)
            cols = np.arange(SPAN - 1)
            at = np.maximum(p[:, None] - 1 - cols, 0)
            m[:, WIDTH : ROW - 2] = np.where(cols < left[:, None], data[at], 0)
            m[:, ROW - 2], m[:, ROW - 1] = right + 1, left + 1
            owner = np.searchsorted(bounds, first, side="right") - 1
            rows.append(m)
            hashes.append(h[keep])
            place.append(np.stack([block.ids[lo + owner], lo + owner, p - bounds[owner]], axis=1))
        m, place, h = np.concatenate(rows), np.concatenate(place), np.concatenate(hashes)
        bucket = np.searchsorted(bucket_edges_values(parts), h, side="right") - 1
        order = sort_rows(m, bucket)
        m, place, bucket = m[order], place[order], bucket[order]
        edge, out = np.searchsorted(bucket, np.arange(parts + 1)), []
        for b in range(parts):
            i, j = edge[b], edge[b + 1]
            if i < j:
                new = np.append(True, (m[i + 1 : j] != m[i : j - 1]).any(axis=1))
                counts = np.diff(np.append(np.flatnonzero(new), j - i)).astype("<u4")
                pl = place[i:j]
                raw = counts.tobytes() + pl[:, 0].astype("<i8").tobytes() + pl[:, 1].astype("<u4").tobytes() + pl[:, 2].astype("<u4").tobytes()
                out.append({"block": key[0].as_py(), "bucket": b, "run": front_code(m[i:j][new]), "places": raw})
        return pa.Table.from_pylist(out, schema)

    return run


def sort_rows(m: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The order of suffix rows within their buckets.

    A row's first eight bytes and its bucket decide nearly all; the rest is only read for rows that tie there.
    """
    words = np.zeros((len(m), -(-ROW // 8) * 8), np.uint8)
    words[:, :ROW] = m
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 2], words[:, 1], words[:, 0], bucket))
    tied = (words[order[1:], :3] == words[order[:-1], :3]).all(axis=1) & (bucket[order[1:]] == bucket[order[:-1]])
    tied = np.append(False, tied) | np.append(tied, False)
    at = np.flatnonzero(tied)
    if len(at):
        group = np.cumsum(np.append(True, (words[order[at[1:]], :3] != words[order[at[:-1]], :3]).any(axis=1) | (bucket[order[at[1:]]] != bucket[order[at[:-1]]])))
        sub = order[at]
        order[at] = sub[np.lexsort((*(words[sub, k] for k in range(words.shape[1] - 1, 2, -1)), group))]
    return order


def bucket_edges_values(parts: int) -> np.ndarray:
    return (np.arange(parts, dtype=object) * (1 << HASH_BITS) // parts).astype(np.uint64)


class LoserTree:
    """Merges sorted runs of (row, prefix shared with the row before) without comparing a known prefix again."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.row: list[bytes | None] = [None] * self.size
        self.known = [-1] * self.size
        for i, r in enumerate(runs):
            self._next(i, 0)
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _next(self, i: int, known: int | None = None) -> None:
        got = next(self.runs[i], None)
        self.row[i], self.known[i] = (None, -1) if got is None else (got[0], got[1] if known is None else known)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser). known[x] is the prefix x shares with the last winner; the loser's becomes that with this one."""
        ka, kb = self.known[a], self.known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = int.from_bytes(self.row[a][ka:]), int.from_bytes(self.row[b][ka:])
        if x > y:
            a, b = b, a
        self.known[b] = ROW - (((x ^ y).bit_length() + 7) >> 3)
        return a, b

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        w, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return w

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(run, row, prefix shared with the row given before) in order; equal rows have ROW in common."""
        while self.row[self.winner] is not None:
            w = self.winner
            yield w, self.row[w], self.known[w]
            self._next(w)
            node = (w + self.size) >> 1
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node >>= 1
            self.winner = w


def settle(group: list, ids: list[array], ords: list[array], ats: list[array], out: dict[int, array]) -> None:
    """Adds the removed ranges of suffixes with one anchor string to out, by run: text, start and end in turn.

    group: [suffix row, [(run, from, to), ...]] for distinct rows; ids, ords and ats hold the places of each run.
    """
    if len(group) == 1:
        row, where = group[0]
        low = min(min(ids[r][i:j]) for r, i, j in where)
        right, left = row[ROW - 2] - 1, row[ROW - 1] - 1
        for r, i, j in where:
            for k in range(i, j):
                if ids[r][k] > low:
                    out.setdefault(r, array("I")).extend((ords[r][k], ats[r][k] - left, ats[r][k] + right))
        return
    least: dict[bytes, int] = {}
    plans = []
    for row, where in group:
        right, left = row[ROW - 2] - 1, row[ROW - 1] - 1
        low = min(min(ids[r][i:j]) for r, i, j in where)
        # a window: how far it begins before the anchor, the bytes before it backwards, the bytes from it on
        windows = [b"%c" % k + row[WIDTH : WIDTH + k] + row[: WIDTH - k] for k in range(WIDTH - right, left + 1)]
        plans.append((right, left, windows))
        for w in windows:
            if low < least.get(w, low + 1):
                least[w] = low
    for (_, where), (right, left, windows) in zip(group, plans):
        floor = [least[w] for w in windows]
        top, bottom = max(floor), min(floor)
        for r, i, j in where:
            for k in range(i, j):
                own, at = ids[r][k], ats[r][k]
                if own > top:
                    out.setdefault(r, array("I")).extend((ords[r][k], at - left, at + right))
                elif own > bottom:
                    mine, m, size = out.setdefault(r, array("I")), 0, len(floor)
                    while m < size:
                        if floor[m] < own:
                            e = m
                            while e + 1 < size and floor[e + 1] < own:
                                e += 1
                            mine.extend((ords[r][k], at - (e + WIDTH - right), at - (m + WIDTH - right) + WIDTH))
                            m = e
                        m += 1


def merge_bucket(key, t):
    runs = t["run"].to_pylist()
    ids, ords, ats, edges, taken = [], [], [], [], []
    for raw, run in zip(t["places"].to_pylist(), runs):
        n = int.from_bytes(run[:4], "little")
        counts = np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64)
        total = int(counts.sum())
        ids.append(array("q", raw[4 * n : 4 * n + 8 * total]))
        ords.append(array("I", raw[4 * n + 8 * total : 4 * n + 12 * total]))
        ats.append(array("I", raw[4 * n + 12 * total :]))
        edges.append(array("q", np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes()))
        taken.append(0)
    out: dict[int, array] = {}
    group: list = []

    def close() -> None:
        if len(group) > 1 or group and (len(group[0][1]) > 1 or group[0][1][0][2] - group[0][1][0][1] > 1):
            settle(group, ids, ords, ats, out)

    for run, row, known in LoserTree([decode_run(r) for r in runs]):
        k = taken[run]
        taken[run] = k + 1
        mine = (run, edges[run][k], edges[run][k + 1])
        if group and known >= ROW:
            group[-1][1].append(mine)
            continue
        if known < GRAM:
            close()
            group = []
        group.append((row, [mine]))
    close()
    blocks = t["block"].to_pylist()
    done = [{"block": blocks[r], "cuts": v.tobytes()} for r, v in out.items()]
    return pa.Table.from_pylist(done, pa.schema([("block", pa.int64()), ("cuts", pa.binary())]))


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def cut_block(with_text: bool):
    def run(key, t, cuts):
        block = Block(t)
        c = [np.frombuffer(x, "<u4").reshape(-1, 3) for x in cuts["cuts"].to_pylist()]
        c = np.concatenate(c).astype(np.int64) if c else np.zeros((0, 3), np.int64)
        c = c[np.lexsort((c[:, 1], c[:, 0]))]
        edge = np.searchsorted(c[:, 0], np.arange(len(block.ids) + 1))
        rows = []
        for lo, hi, data, bounds in slices(block.texts):
            for k in range(lo, hi):
                text = data[bounds[k - lo] : bounds[k - lo + 1]]
                s, e = c[edge[k] : edge[k + 1], 1], c[edge[k] : edge[k + 1], 2]
                spans, removed, kept = 0, 0, text.tobytes()
                if len(s):
                    top = np.maximum.accumulate(e)
                    new = np.append(True, s[1:] > top[:-1])
                    begin, end = s[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                    mask = np.ones(len(text), bool)
                    for i, j in zip(begin.tolist(), end.tolist()):
                        mask[i:j] = False
                    spans, removed, kept = len(begin), int((end - begin).sum()), text[mask].tobytes()
                row = (len(text), removed, spans, hashlib.sha256(kept).hexdigest())
                rows.append(row + ((kept,) if with_text else ()))
        n, r, s, h, *x = zip(*rows) if rows else ((),) * (5 if with_text else 4)
        ids = pa.array(block.ids, pa.int64(), mask=block.missing.to_numpy(zero_copy_only=False) if len(block.ids) else None)
        cols = {"id": ids, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "n_spans": pa.array(s, pa.int64()), "kept_sha256": pa.array(h, pa.string())}
        return pa.table(cols | ({"kept": pa.array(x[0], pa.binary())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document; with_text adds the remaining bytes as `kept`."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), F.col(id_col).isNull().alias("missing"), text.alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("block", F.pmod(F.xxhash64("id", "tie"), F.lit(parts)))
    rows = rows.repartition("block")
    marks = rows.groupBy("block").applyInArrow(grouped(send_hashes(parts)), "block bigint, bucket bigint, run binary").groupBy("bucket").applyInArrow(grouped(mark_shared), "block bigint, bucket bigint, run binary")
    runs = rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(paired(send_suffixes(parts)), "block bigint, bucket bigint, run binary, places binary")
    cuts = runs.groupBy("bucket").applyInArrow(grouped(merge_bucket), "block bigint, cuts binary")
    out = rows.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(paired(cut_block(with_text)), f"id bigint, {RESULT}" + ", kept binary" * with_text)
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
