"""Corpus pipeline: documents that are good, without repeated lines, near copies and personal data, packed for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import discard, fresh, salted_join, without_rows, written
from gridloom.llm.line_dedup import drop_common_lines
from gridloom.llm.packing import best_fit_pack, public_tokenizer
from gridloom.llm.pii import pseudonymise_documents
from gridloom.llm.quality import classify_quality
from gridloom.llm.set_similarity import near_copies

def with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns of documents with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True).filter(F.col(fresh("_kept", docs))).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay only in the document that brought them first."""
    added = tuple(fresh(c, docs) for c in ("n_lines", "n_dropped", "kept_text"))
    return with_text(drop_common_lines(docs, keep_first=True, added=added), F.col(added[2]), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingle sets, similarity 0.8 or more) one row stays: that of the smallest id, ids that
    are null last, and of rows with that id the first."""
    row = fresh("_row", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    ids = numbered.select(F.col(row).alias("_row"), "doc_id")
    found = near_copies(numbered.select(F.col(row).alias("_row"), "text")).join(ids, "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_first")
    dropped = written(salted_join(found, found.groupBy("component").agg(first), ["component"], F.col("_row")).filter("_row <> _first").select("_row"))
    return without_rows(numbered, dropped, row).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return with_text(pseudonymise_documents(docs), F.col("text"), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the packed sequences."""
    return best_fit_pack(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii_pseudonyms", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the classifier, XXH64 or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again, and its input then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
