"""A training corpus in five stages: quality rules, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns to the shared
folder and reads it again as the next one's docs.

A row is judged by its own text: rows of equal doc_id with different texts may part, repeated rows of equal doc_id and text
share each verdict. Null doc_ids are no reason to drop a row. Empty tables give empty tables, and columns besides
doc_id, text, source and n_chars go along whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm import decontaminate, lines, mixing, near_dups, quality
from listingspark.plans.shared import Workspace, made_here

#: The stages learn, sort and hash by means that SQL has no equal for; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a learned rule rejects go. Null and very short texts fail the base test."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs and of lines of 50 words or more are cut from the texts (n_chars follows); documents of
    which no line with a word is left go. Texts that lose nothing stay, null and empty ones too."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    out = lines.drop_repeated_lines(docs, longest=False, prefix=prefix)
    removed, had = F.col(f"{prefix}n_removed"), F.col(f"{prefix}n_lines")
    left = out.filter((removed == 0) | (removed < had))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id. Null doc_ids and texts without words are in no group."""
    found = near_dups.near_duplicates(docs)
    kept = found.filter("kept").select(F.col("doc_id").alias("id"), F.col("fp")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["fp"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("id"), F.col("fp")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["id"]) & (decontaminate.text_key(docs["doc_id"], docs["text"]) == hit["fp"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies (in place of a column of that name). Texts without words
    have no part in a mix."""
    return mixing.mix(docs, rows=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with made_here() as made:
            docs = ws.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for used in made:
            used.remove()
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
