"""From raw documents to token ids: five stages, each calling one text operator.

Every stage takes (spark, docs, sf_dir) and gets what the stage before it kept. All
but the last return the columns of `documents`; the last adds the ids of each text.
Null and empty texts are kept by every filter; rows without an id are judged like
others. Texts of any length are taken whole, ties fall to the smaller key, and columns
beyond those of `documents` pass through, whatever their names (`ids` is replaced by
the last stage). Each filter decides by row, not by id: of rows that share an id, only those go
whose own text is rejected. Rows repeated in id and text become one in the second
stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import bpe, decontaminate, importance, jaccard, pii
from sheetwise.llm.common import fresh, remove, scratch, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws; the labels name good and poor ones."""
    return importance.keep_resampled(docs, table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, never null, and its name: in the order of the ids, rows without one last, then a hash of the text."""
    (name,) = fresh(docs, "key")
    rank = F.lpad(F.hex(F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")  # orders negative ids too
    return docs.withColumn(name, F.concat(F.coalesce(rank, F.lit("none")), F.lit(":"), F.hex(F.xxhash64("text")))), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that of its least id, then of the least hash of its text.

    Rows without an id come last. Null, empty and wordless texts are near to nothing and
    stay; rows repeated in id and text become one.
    """
    keyed, key = _keyed(docs)
    found = jaccard.near_duplicates(keyed, id_col=key)
    # the rows to drop; a row's own key is its component's unless a smaller one is linked to it
    doomed = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return keyed.join(doomed, key, "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a passage of the benchmark; null texts and those of fewer than five words stay."""
    keyed, key = _keyed(docs)
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return keyed.join(found.select(key).distinct(), key, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the kind in brackets; n_chars, if there, follows the text; null texts stay null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `ids`, the byte-pair ids of each text."""
    return bpe.encode(docs, bpe.default_vocabulary(), keep=True)


STAGES = [
    ("quality classifier", select_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("byte-pair encoding", encode_texts),
]
#: The resampling, the boosted spans and the merges have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = scratch(spark, f"stage{k}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if before:
                remove(spark, before)
            before = at
    return docs
