"""Near duplicates: a self join on the Jaccard similarity of word shingles, by partitioned universes.

Texts with the same shingle set form one class and meet once. A pair with similarity
0.8 or more and sizes s <= l has s >= 0.8 l and differs in at most K = (s + l) / 9
shingles. Sizes fall into bands; a class takes part in its own band and, if a larger
partner could lie there, in the next one. Within a band the hash space of shingles is
cut into segments, enough for the pigeonhole principle:

* exact allocation: K + 1 + A segments, of which a pair agrees in A + 1 or more. A
  class writes the K + 1 segments of greatest weight and skips the others. A segment's
  weight is read off its shingles, rare ones count most and common ones hardly, so
  equal segments weigh the same on both sides: the weightiest agreed one has at most K
  others before it, and both sides write it. Empty segments and those that only hold
  a common passage come last and bring no rows together.
* one-deletion allocation: K // 2 + 1 segments; in one of them the pair differs by at
  most one shingle, so the segment of one, or it less one shingle, equals the other's.

Each band takes the allocation of lower cost, from the number of sets in it, counted
over all documents: keys to write against sets that meet by chance. How common a
shingle is comes from counts over all documents too, kept in a table of fixed size;
where they are coarse, keys select less well, and no link is lost.

Each class is first compared with one other, the hub of a bucket, and verified links
are contracted to components. Buckets that still span several
components and have up to SMALL members give the pairs across components, so a key
costs a class at most SMALL comparisons. The members of larger ones are indexed once
more among themselves, with the segments cut down to single shingles: these are
counted exactly over those members, and each set writes as many of its rarest as it
may miss and one more. Two of them that are linked share one of these. Nothing is
capped, and copies are never expanded into pairs.

Similarities are computed on the full sets of 64-bit shingle hashes. A class is told
by a 128-bit hash of its set.

Defined results: words are runs of characters other than space and 0x09-0x0D with
A-Z lower-cased; with 1 to 4 words the whole sequence is the only shingle; null, empty and
wordless texts have an empty set and link with nothing; repeated rows and ids are
kept, one output row each; a component's id is its least non-null id (null if it has none);
texts of any length are taken whole, one at a time; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, table
from .components import components
from .textscan import Scan, mix, scans

SHINGLE = 5
#: Links have 100 * intersection >= 80 * union.
THRESHOLD = 80
#: A band spans sizes up to this ratio.
BAND = 1.6
#: Slots of the table of shingle counts, the least count in a task's chunk that is reported to it, and a chunk's shingles.
SLOTS, REPORTED, CHUNK = 1 << 20, 3, 3_000_000
#: The weight of a shingle that no chunk has reported; reported ones weigh less the more there are.
RARE = 40
#: Buckets with more members are indexed again by single shingles, and members in a row of a larger bucket.
SMALL, ROW = 16, 4096
#: Cells of a sketch, and bytes of a key in a run: the part of a bucket and 40 bits; keys that meet by chance only cost a comparison.
CELLS, KEY_BYTES = 128, 5
#: Hashes of texts that are sent to all tasks rather than joined, at most.
BROADCAST = 1_000_000
_U = np.uint64


def shingle_sets(s: Scan) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at, h = s.windows(SHINGLE)
    first = np.searchsorted(at, s.first)
    for k, n in enumerate(s.n_words):
        if n >= SHINGLE:
            yield np.unique(h[first[k] : first[k + 1]])
        elif n:
            x = s.hashes[s.first[k] : s.first[k + 1]]
            yield mix(np.array([sum(int(v) * pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i, v in enumerate(x)) + int(n) & 2**64 - 1], np.uint64))
        else:
            yield h[:0]


def signature(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set; the first is its class number."""
    a, b = x.sum(dtype=np.uint64), mix(x).sum(dtype=np.uint64)
    c = mix(np.array([a ^ mix(np.array([b], np.uint64))[0]], np.uint64) + _U(len(x)))
    return int(c.view(np.int64)[0]), int(np.array([b]).view(np.int64)[0])


@lru_cache(maxsize=None)
def bands() -> list[tuple[int, int]]:
    """[from, to) of every band of sizes."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo + 1, int(lo * BAND))
        out.append((lo, hi))
        lo = hi
    return out


@lru_cache(maxsize=None)
def most_misses(band: int) -> int:
    """In how many shingles two linked sets of a band differ at most."""
    return 2 * (bands()[band][1] - 1) * (100 - THRESHOLD) // (100 + THRESHOLD)


def allocation(band: int, sets: int) -> tuple[int, int, bool]:
    """(segments, K, one-deletion?) of a band with so many sets; the cheaper of the two allocations.

    Costs are keys a set writes and sets it meets by chance, taking a fifth of all
    shingles as common: segments without a rare shingle meet, unless they can be skipped.
    """
    k, size = most_misses(band), sum(bands()[band]) / 2
    exact, deletion = k + 1 + k // 4 + 1, k // 2 + 1

    def met(segments: int, spare: int) -> float:
        p = math.exp(-0.8 * size / segments)
        mean, deviation = segments * p, math.sqrt(segments * p * (1 - p))
        return sets * max(0.0, mean + deviation - spare) ** 2 / segments

    deleted = k + size + met(deletion, 0) < k + 1 + met(exact, exact - k - 1)
    return (deletion if deleted else exact), k, deleted


def rarities(counts: np.ndarray) -> np.ndarray:
    """The weight of the shingles of each slot of counts."""
    out = np.full(len(counts), RARE, np.uint8)
    known = counts > 0
    out[known] = np.maximum(1, RARE // 2 - np.log2(counts[known])).astype(np.uint8)
    return out


def segment_keys(x: np.ndarray, weights: np.ndarray, plan: list[tuple[int, int, bool]]) -> np.ndarray:
    """The keys of a set in its own band and in the next if a larger partner could lie there; plan: allocations by band."""
    n, out = len(x), [np.zeros(0, np.uint64)]
    own = int(np.searchsorted([b[0] for b in bands()], n, side="right")) - 1
    rarity = weights[(x % _U(len(weights))).astype(np.int64)]
    value = mix(x ^ _U(0xA5A5A5A5A5A5A5A5))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    for band in (own, own + 1):
        if band > own and 100 * n < THRESHOLD * bands()[band][0]:
            break
        m, most, deletion = plan[band]
        if not most:
            continue  # different sets of these sizes cannot link
        seg = ((x >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        edge = np.searchsorted(seg, np.arange(m + 1))
        tag = mix(np.arange(m, dtype=np.uint64) + _U((band + 1) << 44))
        plain = total[edge[1:]] - total[edge[:-1]]
        whole = mix(plain ^ tag)
        if deletion:
            out += [whole, mix((plain[seg] - value) ^ tag[seg])]
        else:
            weight = np.bincount(seg, rarity, m).astype(np.int64)
            out.append(whole[np.lexsort((whole, -weight))[: most + 1]])
    return np.concatenate(out)


def sketch(x: np.ndarray) -> bytes:
    """Counts of a set's shingles in parts of hash space, about four to a part; the lesser counts of two sets bound their intersection."""
    cells = CELLS
    while 4 * cells < len(x):
        cells *= 2
    return np.minimum(np.bincount((x >> _U(20) & _U(cells - 1)).astype(np.int64), minlength=cells), 65535).astype("<u2").tobytes()


def _fold(x: np.ndarray, cells: int) -> np.ndarray:
    """Rows of counts, summed to fewer cells."""
    while x.shape[1] > cells:
        half = x.shape[1] // 2
        x = x[:, :half] + x[:, half:]
    return x


def named(x: np.ndarray, twins: frozenset[int]) -> int:
    """The class number of a set: the first half of its hash, joined with the second where two sets share the first."""
    c, d = signature(x)
    return c ^ d if c in twins else c


def class_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts for two kinds of rows.

    For every document (slot null): id, t (a hash of the text), n (set size), c and d
    (hashes of its set) and its sketch. For shingles that REPORTED classes of a chunk
    share: slot and n, their count.
    """
    names = ["id", "t", "n", "c", "d", "sketch", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held, seen, kind = [], 0, set(), None

        def counted():
            nonlocal fresh, held
            x = np.sort(np.concatenate(fresh))
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            m = np.diff(np.append(first, len(x)))
            key, m = x[first[m >= REPORTED]], m[m >= REPORTED]
            fresh, held = [], 0
            seen.clear()
            none = pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(key), kind), none, pa.array(m.astype(np.int64)), none, none, pa.nulls(len(key), pa.binary()), pa.array((key % _U(SLOTS)).astype(np.int64))], names)

        for b in batches:
            kind = b.column(0).type
            for lo, hi, s in scans(b.column(2), fold=True):
                sets = list(shingle_sets(s))
                n, (c, d) = [len(x) for x in sets], zip(*[signature(x) if len(x) else (0, 0) for x in sets])
                cells = [sketch(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(cells, pa.binary()), pa.nulls(hi - lo, pa.int64())], names)
                for x, k in zip(sets, c):
                    if len(x) and k not in seen:
                        seen.add(k)
                        fresh.append(x)
                        held += len(x)
                if held > CHUNK:
                    yield counted()
        if fresh:
            yield counted()

    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text), text).mapInArrow(run, f"id {kind}, t bigint, n bigint, c bigint, d bigint, sketch binary, slot bigint")


def shingle_counts(scanned: DataFrame) -> np.ndarray:
    """How many classes share a shingle, by its hash modulo SLOTS; shingles that are rare within every chunk count as 0."""
    got = scanned.where("slot is not null").groupBy(F.col("slot").cast("int").alias("slot")).agg(F.sum("n").cast("float").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.float64)  # at most SLOTS rows come to the driver
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def allocations(classes: DataFrame) -> list[tuple[int, int, bool]]:
    """The allocation of every band, by how many sets it has."""
    edges = F.array(*[F.lit(lo).cast("long") for lo, _ in bands()])
    band = F.size(F.filter(edges, lambda lo: lo <= F.col("n"))) - 1
    sets = {r["band"]: r["sets"] for r in classes.where("n > 0").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("sets")).collect()}  # a row a band
    return [allocation(b, sets.get(b, 0) + sets.get(b - 1, 0)) for b in range(len(bands()))]


def buckets(docs: DataFrame, text_col: str, weights: np.ndarray, plan: list[tuple[int, int, bool]], twins: frozenset[int], parts: int) -> DataFrame:
    """Members (class numbers) of all buckets with two classes or more, equal ones once.

    The hub of a bucket is the member whose shingles are most common, for of many variants
    of a text that is the one with the fewest changes. A row has the hash of the whole
    list, its size, the hub's score (the lower, the more common) and up to ROW other
    members after the hub.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights, plan, twins))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, plan, twins = shared.value
        seen: dict[int, int] = {}
        keys, owner, common, held = [], [], [], 0

        def flush():
            nonlocal keys, owner, held
            names, scores = np.fromiter(seen, np.int64, len(seen)), np.array(common, np.uint8)
            k, o = np.concatenate(keys), np.concatenate(owner)
            part = (k % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, o, part = k[order] // _U(parts) & _U((1 << 8 * KEY_BYTES) - 1), o[order], part[order]
            edge = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in range(parts):
                i, j = edge[p], edge[p + 1]
                if i < j:
                    used, at = np.unique(o[i:j], return_inverse=True)
                    short = "<u2" if len(used) < 65536 else "<u4"
                    cut_keys = np.ascontiguousarray(k[i:j]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
                    rows.append((p, int(j - i), len(used), cut_keys + names[used].tobytes() + scores[used].tobytes() + at.astype(short).tobytes()))
            keys, owner, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["part", "keys", "owners", "run"])

        for b in batches:
            for _, _, s in scans(b.column(0), fold=True):
                for x in shingle_sets(s):
                    if len(x):
                        c = named(x, twins)
                        if c not in seen:
                            seen[c] = len(seen)
                            keys.append(segment_keys(x, weights, plan))
                            common.append(int(255 * weights[(x % _U(len(weights))).astype(np.int64)].mean() / RARE))
                            owner.append(np.full(len(keys[-1]), seen[c], np.int64))
                            held += len(keys[-1])
                if held > 1_000_000:
                    yield flush()
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for p, n, m, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                raw = run.as_py()
                k = np.zeros((n, 8), np.uint8)
                k[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8, n * KEY_BYTES).reshape(n, KEY_BYTES)
                names = np.frombuffer(raw, np.int64, m, n * KEY_BYTES)
                scores = np.frombuffer(raw, np.uint8, m, n * KEY_BYTES + 8 * m)
                at = np.frombuffer(raw, "<u2" if m < 65536 else "<u4", n, n * KEY_BYTES + 9 * m)
                parts_of.setdefault(p, []).append((k.view(np.uint64).ravel(), names[at], scores[at]))
        seen: set[bytes] = set()
        rows: list[tuple[bytes, int, int, int, np.ndarray]] = []

        def flush():
            lists = [r[4] for r in rows]
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists)))
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), values], ["list", "size", "chunk", "score", "members"])
            rows.clear()
            return out

        while parts_of:
            _, runs = parts_of.popitem()
            k, o, scores = (np.concatenate([r[x] for r in runs]) for x in range(3))
            order = np.lexsort((o, k))
            k, o, scores = k[order], o[order], scores[order]
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
            k, o, scores = k[fresh], o[fresh], scores[fresh]
            start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            end = np.append(start[1:], len(k))
            many = end - start > 1
            for i, j in zip(start[many].tolist(), end[many].tolist()):
                name = hashlib.blake2b(o[i:j], digest_size=16).digest()
                if name not in seen:
                    seen.add(name)
                    hub = int(np.argmin(scores[i:j]))
                    others = np.delete(o[i:j], hub)
                    rows += [(name, j - i, at, int(scores[i + hub]), np.append(o[i + hub], others[at : at + ROW])) for at in range(0, j - i - 1, ROW)]
                    if len(rows) >= 20000:
                        yield flush()
        if rows:
            yield flush()

    runs = docs.select(F.col(text_col).cast("string")).mapInArrow(write, "part int, keys bigint, owners bigint, run binary")
    return runs.repartition(parts, "part").mapInArrow(gather, "list binary, size bigint, chunk bigint, score bigint, members array<bigint>").dropDuplicates(["list", "chunk"])


def class_sets(docs: DataFrame, wanted: DataFrame, text_col: str, twins: frozenset[int]) -> DataFrame:
    """(c, x): the sets of classes; wanted holds the hash t of a text of each.

    Up to BROADCAST hashes, which are counted first, go to the texts; beyond that both are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies are sent once a task
        for b in batches:
            for _, _, s in scans(b.column(0), fold=True):
                rows = [(c, x.tobytes()) for x in shingle_sets(s) if len(x) and (c := named(x, twins)) not in seen and not seen.add(c)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["c", "x"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(text).alias("t"), text.alias("x")).where("x is not null")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    return rows.join(few, "t", "left_semi").select("x").mapInArrow(run, "c bigint, x binary")


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity; no linked pair is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, all_of = np.zeros(b.num_rows, bool), b.column(4).to_numpy() + b.column(5).to_numpy()
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            kinds: dict[tuple[int, int], list[int]] = {}
            for r, (x, y) in enumerate(zip(left, right)):
                kinds.setdefault((len(x), len(y)), []).append(r)
            for (nx, ny), rows in kinds.items():
                x, y = (np.frombuffer(b"".join(c[r] for r in rows), "<u2").reshape(len(rows), -1).astype(np.int64) for c in (left, right))
                # a cell at its limit says nothing, so the bound is then taken as met
                full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)
                cells = min(nx, ny) // 2
                both = np.minimum(_fold(x, cells), _fold(y, cells)).sum(axis=1)
                ok[rows] = full | (100 * both >= THRESHOLD * (all_of[rows] - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    one = sketches.select(F.col("c").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("ny"))
    two = sketches.select(F.col("c").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
    near = pairs.join(one, "b").join(two, "a").where(100 * F.least("nx", "ny") >= THRESHOLD * F.greatest("nx", "ny"))
    return near.select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok[k] = 100 * both >= THRESHOLD * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    x = sets.select(F.col("c").alias("b"), F.col("x").alias("y"))
    both = pairs.join(x, "b").join(sets.select(F.col("c").alias("a"), "x"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def rarest_meetings(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (c, n, root) of different roots that share one of their rarest shingles.

    A linked pair shares one among the first n - ceil(0.8 n) + 1 of each side, in the
    order of how many members have a shingle; at the first one that it shares, both have
    as many left as the pair must share. Shingles that only one member has come first and
    need not be written. Members of a shingle's largest root only meet those of others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(b.num_rows):
                x = np.frombuffer(b.column(3)[lo].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(x), b.column(k)[lo].as_py(), np.int64)) for k in range(3)), pa.array(x)], ["c", "n", "root", "h"])

    rows = members.join(sets, "c").select("c", "n", "root", "x").mapInArrow(each, "c bigint, n bigint, root bigint, h bigint")
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    own = Window.partitionBy("c")
    ranked = rows.join(counts, "h").select("c", "n", "root", "h", F.row_number().over(own.orderBy("m", "h")).alias("k"), F.count(F.lit(1)).over(own).alias("shared"))
    left = F.col("shared") - F.col("k") + 1  # this shingle and those behind it
    keys = cut(ranked.select("c", "n", "root", "h", left.alias("left")).where(100 * F.col("left") >= THRESHOLD * F.col("n")))
    roots = keys.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max_by("root", "m").alias("main"), F.count(F.lit(1)).alias("roots"))
    marked = keys.join(roots.where("roots > 1").select("h", "main"), "h")
    one, two = (marked.select("h", "main", *(F.col(x).alias(x + i) for x in ("c", "n", "root", "left"))) for i in "12")
    need = THRESHOLD * (F.col("n1") + F.col("n2"))
    near = (F.col("root1") != F.col("root2")) & ((100 + THRESHOLD) * F.col("left1") >= need) & ((100 + THRESHOLD) * F.col("left2") >= need)
    return one.where("root1 <> main").join(two.drop("main"), "h").where(near).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = cut(class_table(docs, id_col, text_col))
    classes = scanned.where("slot is null").drop("slot")
    # one first half of a hash for two sets: less than one case among 2^32 classes
    twins = frozenset(r["c"] for r in classes.where("n > 0").groupBy("c").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("c").collect())
    if twins:
        classes = classes.withColumn("c", F.when(F.col("c").isin(*twins), F.col("c").bitwiseXOR(F.col("d"))).otherwise(F.col("c")))
    lists = cut(buckets(docs, text_col, rarities(shingle_counts(scanned)), allocations(classes), twins, parts))
    # to begin with, one pair for each class: with the best hub of its buckets
    hubs = lists.select("score", F.col("members")[0].alias("a"), F.explode(F.slice("members", F.lit(2), F.size("members"))).alias("b"))
    pairs = hubs.groupBy("b").agg(F.min(F.struct("score", "a"))["a"].alias("a")).select("a", "b")
    members = lists.select(F.explode("members").alias("c")).distinct()
    sketches = cut(classes.where("n > 0").join(members, "c", "left_semi").groupBy("c").agg(F.min("t").alias("t"), F.first("sketch").alias("sketch"), F.min("n").alias("n")))
    # only sets that take part in a likely link are fetched; they lie bucketed, so that no later step moves them again
    name = f"shingle_sets_{uuid.uuid4().hex}"

    def fetch(wanted: DataFrame, mode: str) -> None:
        rows = class_sets(docs, cut(sketches.join(wanted, "c", "left_semi").select("t").distinct()), text_col, twins)
        rows.repartition(parts, "c").dropDuplicates(["c"]).write.mode(mode).bucketBy(parts, "c").saveAsTable(name)

    def add(wanted: DataFrame) -> None:
        lacking = cut(wanted.join(spark.table(name).select("c"), "c", "left_anti"))
        if not lacking.isEmpty():
            fetch(lacking, "append")

    ends = lambda p: p.select(F.col("a").alias("c")).union(p.select(F.col("b").alias("c"))).distinct()
    try:
        candidates = cut(possible(pairs, sketches))
        fetch(ends(candidates), "overwrite")
        links = cut(verified(candidates, spark.table(name)))
        known = cut(sketches.select("c", "n").join(components(links).withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")))
        each = lists.select("list", "size", F.explode("members").alias("c")).join(known, "c")
        split = each.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
        still = cut(each.join(split, "list", "left_semi"))
        member = F.struct("c", "n", "root")
        few = still.where(F.col("size") <= SMALL).groupBy("list").agg(F.collect_list(member).alias("m"))  # at most SMALL of them
        apart = lambda x, y: (x["c"] < y["c"]) & (x["root"] != y["root"]) & (100 * F.least(x["n"], y["n"]) >= THRESHOLD * F.greatest(x["n"], y["n"]))
        across = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: apart(x, y)), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))))
        more = few.select(F.explode(across).alias("p")).select("p.a", "p.b").distinct()
        crowd = cut(still.where(F.col("size") > SMALL).select("c", "n", "root").distinct())
        if not crowd.isEmpty():
            add(crowd.select("c"))
            more = more.union(rarest_meetings(crowd, spark.table(name))).distinct()
        more = cut(possible(more, sketches))
        if not more.isEmpty():
            add(ends(more))
            links = cut(links.unionByName(verified(more, spark.table(name))))
        roots = components(links).select(F.col("node").alias("c"), "root")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    whole = classes.where("n > 0").select("id", "n", "c").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = whole.join(least, "root").select("id", "n", "component_id")
    out = linked.unionByName(classes.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
