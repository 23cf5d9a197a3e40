"""Benchmark decontamination with SimHash over item-sized windows.

Texts become hashes of their 5-word shingles. A window is as many words as a
benchmark item has, begins at a shingle that some item of that length contains (any
window similar to an item can be slid to such a start without losing a common
shingle) and is moved back to fit into the text. The first pass over the texts finds
the places of all windows, each once for a text however often it is hit; only texts
with a window are split again. Windows and items get 64-bit SimHash fingerprints,
counted without a limit. The 64 bits are cut into RADIUS + 1 blocks: two fingerprints
within the radius agree in at least one block, so a join on (length, block, its bits)
finds every pair within it; of the blocks in which a pair agrees the first one brings
it on. Pairs within the radius are then verified by the exact Jaccard similarity of
their shingles, weighted by multiplicity.

At the similarity 0.8 two fingerprints differ in 9.7 bits on average with a standard
deviation of 2.9, so the radius of 24 loses a pair at the very threshold less than
once in a million, and copies never. That radius leaves blocks of two or three bits:
they guarantee the pairs and prune few; the distance and the shared shingle prune.

Only DataFrame expressions are used. Shingles travel one a row, without the arrays
that they come from; the windows of a text are joined to it by a hash of the text.
The tables of shingles, fingerprints and windows are broadcast while they hold at most
`BROADCAST_ROWS` of them, arrays counted by their elements, which is counted first;
beyond that the same joins are shuffled.

Defined results: words are runs of characters other than space and 0x09-0x0D,
lower-cased; texts and items of fewer than 5 words, empty or null have no shingle
and match nothing; a text shorter than an item is one window; texts and items of any
length are taken whole; repeated rows of a document or an item give one row for each
pair of ids, null ids included; of windows that tie the first one counts; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHINGLE = 5
THRESHOLD = 80
RADIUS = 24
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def shingles(ws: Column) -> Column:
    """Hashes of all runs of SHINGLE words."""
    at = F.when(F.size(ws) >= SHINGLE, F.sequence(F.lit(0), F.size(ws) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)]))


def simhash(hashes: Column) -> Column:
    """The 64 majority bits of an array of hashes.

    A long holds four 16-bit counters: a mask picks bits j, j + 16, j + 32 and j + 48
    of a hash shifted by j, so 16 sums count all 64 bits. A bias then lifts the top
    but one bit of each counter that is over half. Arrays of more than 16383 hashes
    take two 32-bit counters and 32 sums.
    """

    def counted(width: int) -> Column:
        lanes = F.lit(sum(1 << k for k in range(0, 64, width)))
        bias = (F.lit((1 << width - 2) - 1) - F.floor(F.size(hashes) / 2)) * lanes

        def majority(j: Column) -> Column:
            sums = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(lanes))
            return F.call_function("shiftleft", F.shiftrightunsigned(sums + bias, width - 2).bitwiseAND(lanes), j)

        return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), lambda bits, j: bits.bitwiseOR(majority(j)))

    return F.when(F.size(hashes) < 1 << 14, counted(16)).otherwise(counted(32))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The radius + 1 pieces of a fingerprint, as (number, bits)."""
    n = radius + 1
    edge = [64 * k // n for k in range(n + 1)]
    cut = lambda k: F.shiftrightunsigned(fingerprint, edge[k]).bitwiseAND(F.lit((1 << (edge[k + 1] - edge[k])) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(k).alias("b"), cut(k).alias("v")) for k in range(n)])


def common(a: Column, b: Column) -> Column:
    """The size of the intersection of two arrays as multisets."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _first_agreed(difference: Column, radius: int = RADIUS) -> Column:
    """The number of the first block without a set bit in the difference of two fingerprints."""
    n = radius + 1
    edge = [64 * k // n for k in range(n + 1)]
    masks = [((1 << edge[k + 1]) - (1 << edge[k])) for k in range(n)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in masks])
    return F.array_position(F.transform(signed, lambda m: difference.bitwiseAND(m) == 0), F.lit(True)) - 1


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start_word, similarity, distance): the best window of each document for each item it resembles."""
    def sided(df: DataFrame, weight: Column = F.lit(1)) -> DataFrame:
        """df, broadcast if its rows, each counted by its weight, are few."""
        return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_ROWS else df

    bench = items.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("ws"))
    bench = bench.select("item", F.size("ws").alias("n"), shingles(F.col("ws")).alias("its")).where(F.col("n") >= SHINGLE)
    keys = bench.select(F.explode_outer("its").alias("h"), "n").distinct()
    prints = bench.select("item", "n", "its", simhash(F.col("its")).alias("item_print"))
    prints = prints.select("*", F.explode_outer(blocks(F.col("item_print"))).alias("k")).select("item", F.col("n").alias("item_n"), "its", "item_print", F.col("k.b").alias("item_b"), F.col("k.v").alias("item_v"))

    # the words are a column of their own: inside the lambda they would be split again for every shingle;
    # the outer forms of explode keep the optimiser from testing the array's size, which would do just that
    text = F.col(text_col).cast("string")
    split = docs.select(F.xxhash64(text).alias("t"), words(text).alias("ws"))
    hashed = split.select("t", F.size("ws").alias("size"), shingles(F.col("ws")).alias("hs"))
    hits = hashed.select("t", "size", F.posexplode_outer("hs").alias("pos", "h")).join(sided(keys), "h")
    start = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("size") - F.col("n")))
    windows = cut(hits.select("t", "n", start.alias("start")).distinct().groupBy("t").agg(F.collect_list(F.struct("n", "start")).alias("windows")))

    rows = docs.select(F.col(id_col).alias("id"), text.alias("x"), F.xxhash64(text).alias("t")).join(sided(windows, F.size("windows")), "t")
    again = rows.select("id", "windows", words(F.col("x")).alias("ws"))
    again = again.select("id", "windows", shingles(F.col("ws")).alias("hs"))
    each = again.select("id", "hs", F.explode_outer("windows").alias("w")).select("id", F.col("w.n").alias("n"), F.col("w.start").alias("start"), F.slice("hs", F.col("w.start") + 1, F.col("w.n") - (SHINGLE - 1)).alias("win"))
    marked = each.withColumn("print", simhash(F.col("win"))).withColumn("blocks", blocks(F.col("print")))
    keyed = marked.select("id", "n", "start", "win", "print", F.explode_outer("blocks").alias("k"))
    pairs = keyed.join(sided(prints, F.size("its")), (F.col("n") == F.col("item_n")) & (F.col("k.b") == F.col("item_b")) & (F.col("k.v") == F.col("item_v")))
    difference = F.col("print").bitwiseXOR(F.col("item_print"))
    # one guarded expression: as filters of their own, the tests would be merged into the join and run on every pair of it
    c = F.when(F.bit_count(difference) <= RADIUS, F.when(_first_agreed(difference) == F.col("k.b"), common(F.col("win"), F.col("its"))))
    counted = pairs.select("id", "item", "start", F.bit_count(difference).alias("distance"), (F.size("win") + F.size("its")).alias("both"), c.alias("c"))
    shared = counted.withColumn("u", F.col("both") - F.col("c")).where(100 * F.col("c") >= THRESHOLD * F.col("u"))
    best = shared.groupBy("id", "item").agg(F.max(F.struct((F.col("c") / F.col("u")).alias("similarity"), (-F.col("start")).alias("back"), (-F.col("distance")).alias("d"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("m.back")).cast("long").alias("start_word"), F.round("m.similarity", 6).alias("similarity"), (-F.col("m.d")).cast("long").alias("distance"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")
