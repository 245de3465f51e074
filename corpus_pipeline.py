"""The corpus pipeline: stages applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
its result is written and read again as the next one's docs. All but the last
return the columns of documents.

1. quality: documents that the classifier rejects go.
2. lines: repeated and nearly repeated lines go; documents of which nothing but
   blank lines is left go with them (texts that were blank before stay).
3. near_duplicates: of each group of near-equal documents the one with the
   smallest id stays. Rows that repeat an id are one document and stay or go together.
4. decontamination: documents in which a benchmark window occurs go.
5. tokens: what is left is encoded; one row per document, with its ids (packed, four bytes each).

Null ids pass every stage: they name no document that could stay instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, decontaminate, jaccard, lines, quality
from llm.common import crc_mod, drop, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(crc_mod("doc_id", 4) != 2).withColumnRenamed("quality", "label")
    model = quality.train(spark, table(spark, sf_dir, "documents", "doc_id", "text"), labels)
    return quality.keep_good(spark, docs, model)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(1).alias("one"), *others).alias("__others"))
    out = lines.dedup_lines(spark, packed, ("__others",), 1)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    rest = {c: F.col("__others")[c] for c in others}
    if "n_chars" in rest:
        rest["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[rest[c].alias(c) if c in rest else F.col(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.join_documents(spark, docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, docs, with_ids=True)


STAGES = [
    ("quality", good_documents),
    ("lines", distinct_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", clean_documents),
    ("tokens", encoded),
]

#: A trained model and connected groups: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
