"""Whole jobs built from the operators: structure a run, score it, compare runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.labels import CONTAINMENT_THRESHOLD
from docstruct.operators.match import greedy_match
from docstruct.operators.metrics import confusion, doc_accuracy, errors, micro_prf
from docstruct.operators.nest import KEYS, nest, to_items
from docstruct.operators.ordered import chunks_for
from docstruct.operators.rules import apply_rules


@dataclass(frozen=True)
class EvaluationPath:
    """One way of scoring: which stage, whether repeated headings are dropped, the threshold."""

    name: str
    rules_applied: bool = False
    dedup_question_title: bool = True
    threshold: float = CONTAINMENT_THRESHOLD


PATH_A = EvaluationPath("A")
PATH_B = EvaluationPath("B", rules_applied=True, dedup_question_title=False)


def structure(blocks: DataFrame, path: EvaluationPath, keys: Sequence[str] = KEYS, chunks: int | str | None = "auto") -> DataFrame:
    """Slots of labeled blocks at the stage *path* scores."""
    if chunks == "auto":
        chunks = chunks_for(blocks, keys)
    slots = nest(blocks, keys, chunks)
    return apply_rules(slots, keys, long_docs=chunks is not None) if path.rules_applied else slots


def convert_run(slots: DataFrame, long_docs: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Stage 3 -> stage 4 of every run in *slots*, and the documents converted per run."""
    return apply_rules(slots, long_docs=long_docs), slots.groupBy("tag").agg(F.count_distinct("doc_id").alias("n_docs"))


def match_run(
    gold: DataFrame, pred: DataFrame, path: EvaluationPath, exclude: Sequence[int] = (), *,
    docs: DataFrame | None = None, long_docs: bool | None = None,
) -> DataFrame:
    """Match rows of gold slots ``(doc_id, ...)`` and predicted slots ``(tag, doc_id, ...)``.

    Documents without items on a side are left out (see `skipped_docs`), as are those in
    *exclude*; *docs* ``(tag, doc_id)`` names the scored ones where a document may be empty.
    *long_docs* is the caller's answer to whether some document is long (see `to_items`).
    """
    if exclude:
        gold, pred = (d.where(~F.col("doc_id").isin(list(exclude))) for d in (gold, pred))
    gold_items = to_items(gold, path.dedup_question_title, ("doc_id",), long_docs)
    pred_items = to_items(pred, path.dedup_question_title, long_docs=long_docs)
    return greedy_match(gold_items, pred_items, path.threshold, docs=docs)


def skipped_docs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(tag, doc_id) of gold documents a run has no prediction for."""
    runs = pred.agg(F.collect_set("tag").alias("t")).scalar()
    seen = pred.groupBy("doc_id").agg(F.collect_set("tag").alias("seen"))
    docs = gold.select("doc_id").distinct().join(seen, on="doc_id", how="left")
    lacking = F.array_except(runs, F.coalesce("seen", F.array().cast("array<string>")))
    return docs.select(F.explode(lacking).alias("tag"), "doc_id")


def evaluate_run(
    gold: DataFrame, pred: DataFrame, path: EvaluationPath = PATH_A, exclude: Sequence[int] = (), long_docs: bool | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy per document, confusion per document, error list). Empty tables when no
    gold document has a prediction."""
    matches = match_run(gold, pred, path, exclude, long_docs=long_docs)
    conf = confusion(matches)
    return doc_accuracy(conf), conf, errors(matches)


def threshold_sweep(gold: DataFrame, pred: DataFrame, path: EvaluationPath, thresholds: Sequence[float], long_docs: bool | None = None) -> DataFrame:
    """Micro scores at each threshold, and the change from the first."""
    out = None
    for t in thresholds:
        at = EvaluationPath(path.name, path.rules_applied, path.dedup_question_title, t)
        rows = micro_prf(confusion(match_run(gold, pred, at, long_docs=long_docs))).withColumn("threshold", F.lit(t))
        out = rows if out is None else out.unionByName(rows)
    base = F.col("threshold") == thresholds[0]
    first = out.groupBy("tag").agg(F.max(F.when(base, F.col("f1"))).alias("_f1"), F.max(F.when(base, F.col("tp"))).alias("_tp"))
    return out.join(first, on="tag").select(
        "tag", "threshold", "tp", "fp", "fn", "precision", "recall", "f1",
        (F.col("f1") - F.col("_f1")).alias("f1_change"), (F.col("tp") - F.col("_tp")).alias("tp_change"),
    )


def two_path_scores(path_a: DataFrame, path_b: DataFrame) -> DataFrame:
    """Documents and micro scores of each run on both paths, from two confusions."""
    docs = path_a.groupBy("tag").agg(F.count_distinct("doc_id").alias("n_docs"))
    cols = ["precision", "recall", "f1"]
    a = micro_prf(path_a).select("tag", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = micro_prf(path_b).select("tag", *[F.col(c).alias(f"b_{c}") for c in cols])
    return docs.join(a, on="tag").join(b, on="tag", how="left")
