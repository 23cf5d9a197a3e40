"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements
and one bit for each rule that the document fails. A policy is a versioned set of
rules: applying one, or asking what a rule costs, only needs bitwise arithmetic on
the stored bits, never the texts again.

Defined results: a null or empty text has no words and fails `few_words`; rows are
judged one by one, so repeated rows and null ids are kept as they come; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textscan import SPACE, range_hash, scans

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
#: Rule name -> SQL predicate over the measurements that is true where a document fails. A rule's place is its bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "repeated_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
#: Policy version -> the rules it enforces.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "shouting"),
}
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def _distinct(group: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The count of distinct keys in each of n groups."""
    if not len(key):
        return np.zeros(n, np.int64)
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(k), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return np.bincount(g[new], minlength=n)


def measure(column) -> dict[str, np.ndarray]:
    """The measurements of every text of an Arrow column."""
    parts = {m: [] for m in MEASURES}
    for _, _, s in scans(column):
        n = len(s.bounds) - 1
        inside = ~SPACE[s.data]
        out = {"n_words": s.n_words}
        out["word_chars"] = s.per_text(inside & ((s.data & 0xC0) != 0x80))
        out["n_symbols"] = s.per_text(_SYMBOL[s.data])
        out["n_upper"] = s.per_text((s.data >= 65) & (s.data <= 90))
        breaks = np.flatnonzero(s.data == 10)
        begin = np.sort(np.concatenate([s.bounds[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([s.bounds[1:], breaks]), kind="stable")
        worded = np.searchsorted(s.start, end) > np.searchsorted(s.start, begin)
        begin, end = begin[worded], end[worded]
        owner = np.searchsorted(s.bounds, begin, side="right") - 1
        out["n_lines"] = np.bincount(owner, minlength=n)
        out["n_dup_lines"] = out["n_lines"] - _distinct(owner, range_hash(s.data, begin, end), n)
        at, h = s.windows(WINDOW)
        owner = s.text_of(at)
        order = np.lexsort((h, owner))
        same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(order) + 1, bool)
        twice[1:-1] = same
        hits = at[order[twice[:-1] | twice[1:]]]
        cover = np.zeros(len(s.start) + 1, np.int64)
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + WINDOW, -1)
        covered = np.zeros(len(s.start) + 1, np.int64)
        np.cumsum(np.cumsum(cover)[:-1] > 0, out=covered[1:])
        out["n_repeat_words"] = covered[s.first[1:]] - covered[s.first[:-1]]
        for m in MEASURES:
            parts[m].append(out[m])
    return {m: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for m, v in parts.items()}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the measurements and fail_bits."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[x]) for x in MEASURES)], [id_col, *MEASURES])

    kept = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    bits = " + ".join(f"CASE WHEN {p} THEN {1 << i}L ELSE 0L END" for i, p in enumerate(RULES.values()))
    return kept.mapInArrow(measured, schema).withColumn("fail_bits", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds `kept`: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects.

    Bits are counted by value first (at most two to the number of rules), so the shuffle is a few rows a task.
    """
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = counts.select("bits", "n", rule.alias("r"))
    failed, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), "v1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")
