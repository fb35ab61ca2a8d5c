"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last returns packed pieces. ``n_chars``
follows the text where a stage changes it. Null texts have no language and go with the first stage, unless nothing could be learned; rows that repeat are documents of
their own until near duplicates go; ties go to the smaller doc_id. Other columns of documents stay, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet.llm import op01_secrets, op02_ngram_join, op03_packing, op04_language_id, op09_line_dedup
from scanfleet.llm.names import free
from scanfleet.session import cut_lineage


def _changed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars of its texts, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. A null lang gets the language found. Where no row has a lang to learn from, nothing can be
    recognised and all documents stay."""
    model = op04_language_id.train(docs.where(op04_language_id.fold(F.col("doc_id"), 3) != 1))
    if not model.languages:
        return docs
    name = free(docs, "_language")
    found = op04_language_id.identify(docs, model, out=name).where(~F.col(name)["rejected"])
    return found.withColumn("lang", F.coalesce(F.col("lang"), F.col(name)["lang"])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has or comes close to. A document that loses every line with a word in it goes."""
    name = free(docs, "_dropped")
    done = op09_line_dedup.dedup_lines(docs, out=name)
    lost = F.size(F.col(name)["same"]) + F.size(F.col(name)["near"])
    return _changed(done.where((lost == 0) | F.col("text").rlike(r"\S")), docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return op02_ngram_join.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind."""
    name = free(docs, "_secrets")
    return _changed(op01_secrets.redact(op01_secrets.find_secrets(docs, out=name), secrets=name), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place."""
    return op03_packing.pack(docs.select("doc_id", "text"), keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Compression and tokenizing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)  # each stage reads its input more than once
    return docs
