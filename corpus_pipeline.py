"""The corpus job: raw documents to the token ids of a clean, deduplicated, balanced mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents. All but the last return the columns of `documents`. A stage
joins its decisions to the documents by identifier: rows that share one stay or go together, rows
without one are decided by their own text where a stage looks at texts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.llm.exact_dedup import exact_duplicates
from docstruct.llm.mixing import mixed
from docstruct.llm.ngram_join import ngram_components
from docstruct.llm.pieces import encode
from docstruct.llm.quality import scored
from docstruct.llm.queries import domain_labels, quality_held_out, table
from docstruct.llm.store import written

#: Shares of the last mix by tokens. What the quality stage rejects has no share of its own.
WEIGHTS = {"clean": 0.98, "rough": 0.0, "toxic": 0.02}


def _keep(docs: DataFrame, decisions: DataFrame, kept: Column) -> DataFrame:
    """The documents whose decision is *kept*, null identifiers included."""
    ids = decisions.where(kept).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranked quality score is at or above the threshold."""
    scores = scored(docs, table(spark, sf_dir, "labels"), quality_held_out())
    return _keep(docs, scores, F.col("predicted") == 1)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest identifier."""
    return _keep(docs, exact_duplicates(docs, keep="largest"), F.col("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, Jaccard 0.8): the smallest
    identifier, which names the component."""
    parts = ngram_components(docs, words=5, num=4, den=5)
    return _keep(docs, parts, F.col("doc_id").eqNullSafe(F.col("component_id")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned out to the target weights; none is repeated. Clean text comes
    whole as far as the other domains' parts in the same documents let it."""
    parts = mixed(docs, domain_labels(table(spark, sf_dir, "labels")), WEIGHTS, whole="clean", max_rate=1.0)
    return parts.where("copies > 0").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with seeded merge-dropout."""
    return encode(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pieces", pieces)]

#: Three stages are learned or iterated: no SQL. The tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``<sf_dir>/documents.parquet``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
