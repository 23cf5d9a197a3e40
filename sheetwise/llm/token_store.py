"""Token-id shards with a minimal perfect hash index.

A store is a folder of shard files in ascending key order and a Parquet manifest
(one row a shard). A shard file is

    payload    all ids of its documents, one after the other (uint16 where the vocabulary allows it, else uint32)
    keys       int64, one a row, ascending; rows with a null key come first and are counted in the footer
    starts     uint64, rows + 1 offsets into the payload, in ids
    pilots     uint32, one a hash bucket
    slots      (fingerprint uint32, row uint32), one a distinct key
    footer     JSON with the section offsets, then its length (uint32) and the magic

The hash sends a key to a bucket, the bucket's pilot sends it to its slot, and the
stored fingerprint tells an absent key from a present one, all but once in 2^32, when
the stored key does: reading a document takes one pilot, one slot, its key, two offsets
and one contiguous read, whatever the size of the shard. Reading a whole store goes
through the same index, key by key. Files go
through pyarrow's file systems, to a temporary name first, so a repeated task
replaces its own file.

Defined results: null and empty texts hold the end id alone; repeated rows and rows
sharing a key are all stored, side by side (ties ordered by a hash of the text, then the text), and a
lookup returns all of them; rows with a null key are stored before all others and
have no index entry; texts of any length are encoded whole; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import scratch, table
from .textscan import RunTable, mix, parts, scans

MAGIC = b"TOKSHRD1"
KEYS_PER_BUCKET = 4
MANIFEST = "shard int, file string, first_key bigint, last_key bigint, n_rows bigint, n_ids bigint"
_U = np.uint64


def hash_keys(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(np.uint64)) + _U(seed * 0x9E3779B97F4A7C15 % 2**64))


def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return mix(h ^ mix(pilot.astype(np.uint64) + _U(1))) % _U(n)


def build_index(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, pilots, slot of each key) for distinct keys: a bijection onto range(len(keys))."""
    n = len(keys)
    buckets = n // KEYS_PER_BUCKET + 1
    for seed in range(64):
        h = hash_keys(keys, seed)
        if len(np.unique(h)) < n:
            continue
        bucket = (h % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        taken, pilots, slots = np.zeros(n, bool), np.zeros(buckets, np.uint32), np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = order[begin[b] : begin[b + 1]]
            low, step = 0, 32
            while True:
                tries = np.arange(low, low + step, dtype=np.uint64)
                at = _slot(h[own][:, None], tries[None, :], n).astype(np.int64)
                ok = ~taken[at].any(axis=0)
                if len(own) > 1:
                    s = np.sort(at, axis=0)
                    ok &= (s[1:] != s[:-1]).all(axis=0)
                if ok.any():
                    k = int(np.argmax(ok))
                    break
                low, step = low + step, min(4 * step, 65536)
                if low > 1 << 31:
                    k = -1
                    break
            if k < 0:
                break
            pilots[b] = low + k
            slots[own] = at[:, k]
            taken[at[:, k]] = True
        else:
            return seed, pilots, slots
        if taken.all():
            return seed, pilots, slots
    raise ValueError("no perfect hash found for these keys")


def fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    return (hash_keys(keys, seed ^ 0x5BD1) >> _U(32)).astype(np.uint32)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class LibraryEncoder:
    """Ids of whole texts from the tokenizers library.

    White space parts a text into pieces that never influence one another; so does
    the place where closing punctuation follows an ASCII letter or digit. Each
    distinct part is encoded once a process, parts that differ by ASCII case
    together, as the vocabulary lower-cases. New parts go to the library many at a
    time: Latin letters alone form one word, so such parts are joined by spaces and
    each ends where an id carries the vocabulary's word end; other parts are joined
    by a special token, whose id shows where each ends, and go alone if one of them
    holds that token. Parts are told apart by 64-bit hashes.
    """

    PARTS = 64
    LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["normalizer"].get("normalizers", [spec["normalizer"]])
        self.fold = any(n["type"] == "Lowercase" for n in steps)
        self.tokenizer, self.dtype = Tokenizer.from_file(path), f"<u{width}"
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        closing = set(b".,!?;:*#$%&") - set("".join(self.special).encode())
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.closing = np.isin(np.arange(256), list(closing))
        self.beginnings = tuple({t[:2].encode() for t in self.special})
        self.known = RunTable(self.dtype)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, each: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the ids of parts that are one word each, and all ids."""
        ids = np.concatenate(self._alone([" ".join(each[k : k + self.PARTS]) for k in range(0, len(each), self.PARTS)]))
        return np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), ids

    def _others(self, each: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.special:
            mark, mark_id = next(iter(self.special.items()))
            ids = self._alone([mark.join(each)])[0]
            cuts = np.flatnonzero(ids == mark_id)
            if len(cuts) == len(each) - 1:
                return np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1, np.delete(ids, cuts)
        runs = self._alone(each)
        return np.fromiter(map(len, runs), np.int64, len(runs)), np.concatenate(runs)

    def _learn(self, keys: np.ndarray, each: list[str]) -> None:
        """Add new keys and the ids of their parts to the table."""
        word = np.fromiter((self.ends is not None and bool(self.LETTERS.fullmatch(p)) for p in each), bool, len(each))
        for mask, encode in ((word, self._words), (~word, self._others)):
            if mask.any():
                self.known.add(keys[mask], *encode([each[k] for k in np.flatnonzero(mask)]))

    def payloads(self, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of an Arrow column: all ids of its texts, and where each text's begin and the last one's end."""
        for _, _, s in scans(column, self.fold):
            begin, end, keys, texts = parts(s, self.closing, self.beginnings)
            keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            lacking = np.flatnonzero(self.known.missing(keys))
            if len(lacking):
                raw, at = s.data.tobytes(), first[lacking]
                self._learn(keys[lacking], [raw[i:j].decode("utf-8") for i, j in zip(begin[at].tolist(), end[at].tolist())])
            ids, lengths = self.known.lay_out(self.known.find(keys)[inverse])
            ends = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=ends[1:])
            yield ids, ends[texts]


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def write_store(docs: DataFrame, to: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every whole text and write the store at the URI `to`; returns its manifest."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    top = max(end_id, *spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"]))
    width = 2 if top < 1 << 16 else 4
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = filesystem(to)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(to)
        encoder = _encoders.get((vocabulary, width)) or _encoders.setdefault((vocabulary, width), LibraryEncoder(vocabulary, width))
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}.tok"
        temporary = f"{root}/_{name}.{uuid.uuid4().hex}"
        keys, sizes, nulls, out = [], [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            out = out or fs.open_output_stream(temporary)
            nulls += b.column(0).null_count
            keys.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            for ids, bounds in encoder.payloads(b.column(1)):
                # the end id after each text
                out.write(np.insert(ids, bounds[1:], end_id).tobytes())
                sizes.append(np.diff(bounds) + 1)
        if out is None:
            return
        keys = np.concatenate(keys).astype("<i8")
        starts = np.zeros(len(keys) + 1, "<u8")
        np.cumsum(np.concatenate(sizes), out=starts[1:])
        distinct, row = np.unique(keys[nulls:], return_index=True)
        seed, pilots, slots = build_index(distinct) if len(distinct) else (0, np.zeros(1, np.uint32), np.zeros(0, np.int64))
        table_of_slots = np.zeros((len(distinct), 2), "<u4")
        table_of_slots[slots, 0], table_of_slots[slots, 1] = fingerprints(distinct, seed), row + nulls
        total = int(starts[-1])
        footer, at = {"width": width, "rows": len(keys), "nulls": int(nulls), "keys_n": len(distinct), "seed": seed, "ids": total}, total * width
        for section, part in (("keys", keys), ("starts", starts), ("pilots", pilots.astype("<u4")), ("slots", table_of_slots)):
            raw = part.tobytes()
            footer[section] = [at, len(raw)]
            out.write(raw)
            at += len(raw)
        raw = json.dumps(footer).encode()
        out.write(raw + struct.pack("<I", len(raw)) + MAGIC)
        out.close()
        fs.move(temporary, f"{root}/{name}")
        first, last = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "first_key": first, "last_key": last, "n_rows": len(keys), "n_ids": total}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_rows", pa.int64()), ("n_ids", pa.int64())]))

    # the second key only splits ids that many rows share
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("tie", F.xxhash64("t"))
    ordered = rows.repartitionByRange(n, "k", "tie").sortWithinPartitions("k", "tie", "t").select("k", "t")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{to}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{to}/manifest")


class Shard:
    """Keyed access to one shard file: only the footer is read when it is opened."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, self.path = fs.open_input_file(path), path
        size = self.file.size()
        length, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.footer = json.loads(self.file.read_at(length, size - 12 - length))
        self.dtype = f"<u{self.footer['width']}"

    def section(self, name: str, dtype: str, first: int = 0, n: int | None = None) -> np.ndarray:
        """n numbers of a section from the first on, or all of them."""
        at, length = self.footer[name]
        width = np.dtype(dtype).itemsize
        return np.frombuffer(self.file.read_at(length if n is None else n * width, at + first * width), dtype)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        width = self.footer["width"]
        return np.frombuffer(self.file.read_at((hi - lo) * width, lo * width), self.dtype)

    def find(self, key: int) -> int | None:
        """The first row with the key, or None: a pilot, a slot and, if its fingerprint fits, the key are read."""
        n = self.footer["keys_n"]
        if not n:
            return None
        k = np.array([key], np.int64)
        h = hash_keys(k, self.footer["seed"])
        pilot = self.section("pilots", "<u4", int(h[0] % _U(self.footer["pilots"][1] // 4)), 1)
        fingerprint, row = self.section("slots", "<u4", 2 * int(_slot(h, pilot, n)[0]), 2)
        if fingerprint != fingerprints(k, self.footer["seed"])[0]:
            return None
        return int(row) if self.section("keys", "<i8", int(row), 1)[0] == key else None

    def find_all(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, all of which the shard must have."""
        pilots, slots = self.section("pilots", "<u4"), self.section("slots", "<u4").reshape(-1, 2)
        h = hash_keys(keys, self.footer["seed"])
        at = _slot(h, pilots[(h % _U(len(pilots))).astype(np.int64)], self.footer["keys_n"])
        found = slots[at.astype(np.int64)]
        if (found[:, 0] != fingerprints(keys, self.footer["seed"])).any():
            raise ValueError(f"the index of {self.path} lacks some of its keys")
        return found[:, 1].astype(np.int64)

    def get(self, key: int) -> list[np.ndarray]:
        row, out = self.find(key), []
        while row is not None and row < self.footer["rows"] and self.section("keys", "<i8", row, 1)[0] == key:
            out.append(self.ids(*map(int, self.section("starts", "<u8", row, 2))))
            row += 1
        return out


class TokenStore:
    """Keyed access to a whole store: the manifest names the shards that can hold a key."""

    def __init__(self, spark: SparkSession, at: str):
        rows = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").where("first_key is not null").orderBy("shard").collect()
        self.fs, self.root = filesystem(at)
        self.rows, self.last, self.open = rows, [r.last_key for r in rows], {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every row with the key."""
        out: list[np.ndarray] = []
        k = bisect_left(self.last, key)
        while k < len(self.rows) and self.rows[k].first_key <= key:
            name = self.rows[k].file
            shard = self.open.get(name) or self.open.setdefault(name, Shard(self.fs, f"{self.root}/{name}"))
            out += shard.get(key)
            k += 1
        return out


def read_store(spark: SparkSession, at: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored row, read from the files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{at}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row a shard: the window and the deal are as small as the manifest
    files = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("base"))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").select("file", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(at)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(fs, f"{root}/{name}")
                keys, starts, nulls = s.section("keys", "<i8").astype(np.int64), s.section("starts", "<u8").astype(np.int64), s.footer["nulls"]
                distinct, copies = np.unique(keys[nulls:], return_counts=True)
                first = s.find_all(distinct) if len(distinct) else distinct
                # rows without a key by position, all others where the index has the first row of their key
                rows = np.concatenate([np.arange(nulls), np.repeat(first, copies) + np.arange(len(keys) - nulls) - np.repeat(np.cumsum(copies) - copies, copies)])
                for lo in range(0, len(rows), 1024):
                    own = rows[lo : lo + 1024]
                    crcs = [zlib.crc32(s.ids(i, j).astype("<u4").tobytes()) for i, j in zip(starts[own].tolist(), starts[own + 1].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own], pa.int64(), mask=own < nulls), pa.array(starts[own] + base), pa.array(starts[own + 1] - starts[own]), pa.array(crcs, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), at, default_vocabulary())
    return read_store(spark, at)
