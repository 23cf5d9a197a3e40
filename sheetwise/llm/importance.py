"""A quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: the target
model over labelled good documents, the raw model over every document. A document's
weight is the sum of the log ratios of its n-grams, per 100 words. Ratios within
`NOISE` standard errors of their own bucket's counts count as none, so ordinary
documents weigh about 0 and each n-gram that good text avoids pulls the weight down. Documents are then drawn
without replacement by Gumbel top-k: weight over temperature plus Gumbel noise from
a hash of the document, and the k largest stay. k is the number of documents above
the weight that best separates the labelled sample.

The labelled sample is bounded by `LABELLED` rows, picked by a hash of the id. The
model table grows with the text of the good ones among them, to about a bucket for
each of their n-grams, so what shares a bucket with an n-gram adds about one to its
target count and as much to the count expected of it, however large the corpus; from
`MOST` buckets on it stays. Both models' raw counts, the weights, k and the cut are
computed over all documents. Task counts travel as compressed pieces of the table, and
only ratios that count come to the driver.

Defined results: null and empty texts have weight 0; without usable labels all
documents stay; repeated rows get equal keys and share their fate, as do ties at the
cut; null ids are scored like others; other columns pass through `keep_resampled`
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, table
from .textscan import mix, range_hash, scans

#: Buckets of the model table, at least and at most, and the pieces it is summed in.
FEWEST, MOST, PIECES = 1 << 17, 1 << 24, 256
LABELLED = 20_000
#: Pseudo-counts on either side of a ratio, and the standard errors that a log ratio must exceed to count.
PRIOR, NOISE = 4.0, 2.0
#: Words of neutral text that every document is given, so that a few words don't decide.
NEUTRAL_WORDS = 50
#: The threshold lies this many temperatures below the weight 0; a wrongly rejected labelled document costs as much as so many right rejections.
SHARPNESS, COST = 20.0, 10.0
_U = np.uint64


def _features(s, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbouring words."""
    at, pair = s.windows(2)
    owner = np.repeat(np.arange(len(s.first) - 1), s.n_words)
    buckets = np.concatenate([s.hashes, pair]) % _U(size)
    return np.concatenate([owner, owner[at]]), buckets.astype(np.int64)


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, good) of at most `bound` labelled documents; a document is good if no label calls it poor or toxic."""
    each = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    picked = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return picked.select(F.col("doc_id").alias("label_id"), (F.expr("q >= 1 and t = 0")).alias("good"))


def table_size(n_bytes: int) -> int:
    """Buckets for so many bytes of good text; an n-gram takes about three bytes of it."""
    size = FEWEST
    while size < min(n_bytes // 3, MOST):
        size *= 2
    return size


def ngram_counts(rows: DataFrame, size: int) -> DataFrame:
    """(piece, n_raw, n_target, raw, target) over rows of (text, good): the counts of each piece of the table, compressed, and their sums."""
    width = size // PIECES
    names, kinds = ["piece", "n_raw", "n_target", "raw", "target"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    pack = lambda x: pa.compress(x.tobytes(), codec="zstd", asbytes=True)

    def row(piece: int, raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        values = [piece, int(raw.sum(dtype=np.int64)), int(target.sum(dtype=np.int64)), pack(raw), pack(target)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(PIECES):
            raw, target = total[:, k * width : (k + 1) * width]
            if raw.any():
                yield row(k, raw, target)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((2, size), np.uint32), 0
        for b in batches:
            good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, s in scans(b.column(0)):
                owner, bucket = _features(s, size)
                if held + len(bucket) >= 1 << 32:  # before a count could overflow
                    yield from pieces(total)
                    total[:], held = 0, 0
                held += len(bucket)
                np.add.at(total[0], bucket, np.uint32(1))
                np.add.at(total[1], bucket[good[lo:hi][owner]], np.uint32(1))
        yield from pieces(total)
        del total
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, *both in zip(b.column(0).to_pylist(), b.column(3), b.column(4)):
                total = sums.setdefault(k, np.zeros((2, width), np.int64))
                for c, raw in enumerate(both):
                    total[c] += np.frombuffer(pa.decompress(raw.as_py(), 4 * width, codec="zstd"), np.uint32)
        for k, (raw, target) in sums.items():
            yield row(k, raw, target)

    kind = "piece int, n_raw bigint, n_target bigint, raw binary, target binary"
    parts = min(PIECES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(count, kind).repartition(parts, "piece").mapInArrow(gather, kind)


def log_ratios(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """The log ratios by bucket, 0 where the counts can't tell them from none; share: of all n-grams in good text."""
    expected = raw * share + PRIOR
    ratio = np.log((target + PRIOR) / expected)
    return np.where(np.abs(ratio) * np.sqrt(expected) >= NOISE, ratio, 0.0)


@dataclass
class Ratios:
    """The log ratios other than 0 of a table of `size` buckets."""

    size: int
    buckets: np.ndarray
    values: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        out[self.buckets] = self.values
        return out


def fit_ratios(rows: DataFrame) -> Ratios:
    """The model over rows of (text, good)."""
    size = table_size(rows.where("good").agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    width = size // PIECES
    counts = cut(ngram_counts(rows, size))
    n_raw, n_target = counts.agg(F.sum("n_raw"), F.sum("n_target")).first()
    share = (n_target or 0) / max(n_raw or 0, 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, *both in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                ratio = log_ratios(*[np.frombuffer(pa.decompress(x.as_py(), 8 * width, codec="zstd"), np.int64) for x in both], share)
                at = np.flatnonzero(ratio)
                yield pa.RecordBatch.from_arrays([pa.array(at + k * width), pa.array(ratio[at].astype(np.float32))], ["bucket", "ratio"])

    got = counts.select("piece", "raw", "target").mapInArrow(judge, "bucket bigint, ratio float").toArrow()
    return Ratios(size, got["bucket"].to_numpy(), got["ratio"].to_numpy())


def weigh(column, salt, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, weight, Gumbel noise) of every text of an Arrow column; salt: a 64-bit number a row."""
    words, weights, noise = [], [], []
    salt = np.asarray(salt).astype(np.int64).view(np.uint64)
    for lo, hi, s in scans(column):
        owner, bucket = _features(s, len(ratios))
        total = np.bincount(owner, ratios[bucket], minlength=hi - lo)
        words.append(s.n_words)
        weights.append(100.0 * total / (s.n_words + NEUTRAL_WORDS))
        h = mix(range_hash(s.data, s.bounds[:-1], s.bounds[1:]) ^ mix(salt[lo:hi]))
        noise.append(-np.log(-np.log(((h >> _U(11)).astype(float) + 0.5) / 2.0**53)))
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return join(words, np.int64), join(weights, float), join(noise, float)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, gather: int = 10_000) -> float:
    """The exact k-th largest finite value, by histograms that narrow to a bin of at most `gather` rows or one value."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while hi > lo:
        bin_of = F.least(F.floor((F.col(column) - lo) * (bins / (hi - lo))), F.lit(bins - 1))
        inside = rows.where(F.col(column).between(lo, hi))
        found = {r.b: r for r in inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b].n >= k:
                break
            above += found[b].n
        lo, hi = found[b].lo, found[b].hi
        if found[b].n <= gather:
            values = sorted((r[0] for r in rows.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)
            return values[k - above - 1]
    return lo


@dataclass
class Resampler:
    """A fitted classifier: the log ratios, the temperature and the key at the cut."""

    ratios: Ratios
    temperature: float
    cut: float
    k: int


def _salted(docs: DataFrame, id_col: str):
    return F.xxhash64(F.col(id_col))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED) -> tuple[Resampler, DataFrame]:
    """The resampler, and (id, n_words, weight, key, kept) of every document."""
    sample = F.broadcast(cut(labelled_sample(labels, bound)))
    plain = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    rows = plain.join(sample, F.col(id_col) == F.col("label_id"), "left")
    ratios = fit_ratios(rows.select("t", "good"))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value.table()
        for b in batches:
            words, weight, noise = weigh(b.column(1), b.column(2), ratios)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(words), pa.array(weight), pa.array(noise)], [id_col, "good", "n_words", "weight", "noise"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = cut(rows.select(id_col, "t", _salted(docs, id_col), "good").mapInArrow(score, f"`{id_col}` {kind}, good boolean, n_words bigint, weight double, noise double"))
    # one weight for each labelled id, of at most `bound`, so that repeated ids neither grow it nor leave it to chance
    known = scored.where("good is not null").groupBy(id_col).agg(F.min("weight").alias("weight"), F.first("good").alias("good")).select("weight", "good").collect()
    threshold = best_threshold([r.weight for r in known], [r.good for r in known])
    temperature = max(-threshold, 1e-3) / SHARPNESS
    keyed = scored.withColumn("key", F.col("weight") / temperature + F.col("noise"))
    k = scored.where(F.col("weight") >= threshold).count()
    at = kth_largest(keyed, "key", k) if k else float("inf")
    out = keyed.select(id_col, "n_words", "weight", "key", (F.col("key") >= F.lit(at)).alias("kept"))
    return Resampler(ratios, temperature, at, k), out


def best_threshold(weights: list[float], good: list[bool]) -> float:
    """The weight from which on documents pass: the most poor documents below it, each good one there costing COST."""
    if not weights or all(good) or not any(good):
        return -1e9
    w, g = np.array(weights), np.array(good, bool)
    order = np.argsort(w, kind="stable")
    w, gain = w[order], np.cumsum(np.where(g[order], -COST, 1.0))
    last = np.flatnonzero(np.append(w[1:] != w[:-1], True))[:-1]
    last = last[w[last] < 0]
    if not len(last) or gain[last].max() <= 0:
        return -1e9
    at = last[np.argmax(gain[last])]
    return float((w[at] + min(w[at + 1], 0.0)) / 2)


def keep_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the resampling keeps, with all their columns; no shuffle of texts."""
    model, _ = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.ratios)
    temperature, at = model.temperature, model.cut

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value.table()
        for b in batches:
            n = b.num_columns
            _, weight, noise = weigh(b.column(n - 2), b.column(n - 1), ratios)
            kept = pa.array(weight / temperature + noise >= at)
            yield pa.RecordBatch.from_arrays(b.columns[: n - 2], b.schema.names[: n - 2]).filter(kept)

    text, salt = fresh(docs, "text", "salt")
    return docs.select("*", F.col(text_col).cast("string").alias(text), _salted(docs, id_col).alias(salt)).mapInArrow(choose, docs.schema)


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[1]
