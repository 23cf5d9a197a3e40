"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of the XXH64 values of its 4-word
shingles have it; two fingerprints link when at most RADIUS of their 64 bits differ.

Covering masks: every bit position gets a nonzero vector of RADIUS + 1 bits, all such
vectors equally often, and each nonzero vector v gives one table, whose mask holds the
positions with an odd product with v. RADIUS differing positions span at most RADIUS
dimensions, so some v is orthogonal to all of them and that table's mask misses every
difference: the pair shares a key there. With RADIUS 4 there are 31 tables and masks of
32 to 34 bits, so unlike fingerprints hardly meet. No pair within the radius is lost.

Only distinct fingerprints take part, so copies cost nothing. A bucket is counted
before anything gathers it. Up to BUCKET members are compared in one task, which
returns a spanning forest of their links, never the pairs. The members of a larger
bucket agree under its mask, so they are dealt once more by covering masks over its
other positions. Members that agree there too differ in 16 positions at most, so one
task gathers at most 65,536 of them, whatever the table. Links are contracted to
components by checkpointed star steps.

Defined results: words are runs of characters other than space and 0x09-0x0D, with A-Z
lower-cased; with 1 to 3 words the whole sequence is the only shingle; null, empty and
wordless texts have the fingerprint zero and link like others; repeated rows and ids
stay, one output row each; a component's id is its least non-null id (null if it has
none); texts of any length are taken whole, a slice of shingles at a time; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, fresh, shared_dir, table
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Members of a bucket that one task compares with each other.
BUCKET = 8192
#: A fingerprint with at least one row in this many counts as hot: there are at most so many.
HOT = 1000
#: Shingles hashed at once, and small buckets compared at once.
SLICE = 1 << 16
SMALL = 64
_BITS = np.arange(64, dtype=np.uint64)


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over bit positions: any `radius` of the positions are all missed by one of the masks."""
    vectors = (1 << radius + 1) - 1
    given = [(p, k % vectors + 1) for k, p in enumerate(positions)]
    return [sum(1 << p for p, m in given if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned number."""
    words = text.lower().split()  # bytes: only A-Z change, and words end at 0x20 and 0x09-0x0D alone
    if not words:
        return 0
    last = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, last, SLICE):
        part = words[lo : lo + SLICE + SHINGLE - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > last).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the signed 64-bit fingerprint of each text."""
    (name,) = fresh(docs, "text")
    kept = [c for c in docs.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t.as_py() or b"") for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], [*b.schema.names[:-1], out])

    rows = docs.select(*kept, F.col(text_col).cast("string").cast("binary").alias(name))
    return rows.mapInArrow(run, rows.drop(name).withColumn(out, F.lit(0).cast("bigint")).schema)


def forest(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of some distinct fingerprints the place of one that stands for its linked group.

    A group grows from one member: each member reached takes those it links with out of
    the rest, so a dense group costs little more than its size.
    """
    root, left = np.arange(len(prints)), np.arange(len(prints))
    while len(left):
        first, left = left[0], left[1:]
        reached = [first]
        while reached and len(left):
            near = np.bitwise_count(prints[left] ^ prints[reached.pop()]) <= radius
            if near.any():
                root[left[near]] = first
                reached += left[near].tolist()
                left = left[~near]
    return root


def _small(prints: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int) -> np.ndarray:
    """The same for many small groups that lie one after the other; size: members of each row's group."""
    root = np.arange(len(prints))
    one, two = [], []
    for d in range(1, int(size.max(initial=0))):
        at = np.flatnonzero(group[d:] == group[:-d])
        at = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= radius]
        one.append(at)
        two.append(at + d)
    if one:
        a, b = np.concatenate(one), np.concatenate(two)
        while True:  # the least place spreads along the links
            low = np.minimum(root[a], root[b])
            if (root[a] == low).all() and (root[b] == low).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
    return root


def _forests(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span the linked groups of each bucket; buckets: an array of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            size = np.diff(lists.offsets.to_numpy())
            prints = lists.flatten().to_numpy().view(np.uint64)
            group, size = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
            small = np.flatnonzero(size <= SMALL)
            root = np.arange(len(prints))
            root[small] = small[_small(prints[small], group[small], size[small], radius)]
            large = np.flatnonzero(size > SMALL)
            for at in np.split(large, np.flatnonzero(np.diff(group[large])) + 1) if len(large) else []:
                root[at] = at[forest(prints[at], radius)]
            other = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (prints[root[other]], prints[other])], ["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(masks: list[int]) -> Column:
    return F.array(*(F.lit(_signed(m)).cast("bigint") for m in masks))


def _within(dealt: DataFrame, keys: list[str], radius: int, sizes: DataFrame) -> DataFrame:
    """Links that span the buckets named in sizes, which are bounded."""
    return _forests(dealt.join(sizes, keys).groupBy(*keys).agg(F.collect_list("fp").alias("m")).select("m"), radius)


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints (fp) within the radius."""
    masks = covering(list(range(64)), radius)
    dealt = prints.select("fp", F.posexplode(_longs(masks)).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = cut(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    found = _within(dealt, ["t", "key"], radius, sizes.where(F.col("size") <= bucket).drop("size"))
    crowded = sizes.where(F.col("size") > bucket).drop("size")
    if crowded.isEmpty():
        return found
    # the positions outside a table's mask are dealt like all positions before
    inner = F.array(*(_longs(covering([p for p in range(64) if not m >> p & 1], radius)) for m in masks))
    again = dealt.join(crowded, ["t", "key"]).select("fp", "t", "key", F.posexplode(inner[F.col("t")]).alias("t2", "mask"))
    again = again.select("fp", "t", "key", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"))
    keys = ["t", "key", "t2", "key2"]
    return found.unionByName(_within(again, keys, radius, again.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")))


def _looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the columns of values, which has each key once and, as n, its number of rows.

    Keys that hold a share of 1 / HOT of all rows, HOT of them at most, are broadcast, so
    that no task gets all rows of such a key.
    """
    hot = values.where(F.col("n") * HOT >= rows.count()).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) of every document; fingerprint in 16 lowercase hex digits."""
    shared_dir(docs.sparkSession)
    rows = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), out="fp").select("id", "fp"))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(prints.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    rooted = cut(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = cut(_looked_up(rooted.select("fp", "root", F.col("n").alias("rows")), least, "root").select("fp", "component_id", F.col("rows").alias("n")))
    return _looked_up(rows, named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
