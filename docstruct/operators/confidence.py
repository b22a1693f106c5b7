"""Does a block's confidence tell right labels from wrong ones?

Rows here are ``(keys..., confidence, correct)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.labels import ANSWER
from docstruct.operators.match import best_label

# Calibration buckets as (lower edge, name, midpoint); closed on the left, the last
# one ends below 1.01.
BUCKETS = [
    (0.0, "<0.5", 0.25), (0.5, "0.5-0.6", 0.55), (0.6, "0.6-0.7", 0.65), (0.7, "0.7-0.8", 0.75),
    (0.8, "0.8-0.9", 0.85), (0.9, "0.9-0.95", 0.925), (0.95, ">=0.95", 0.975),
]
TOP_EDGE = 1.01
HIGH = 0.9


def confidence_rows(blocks: DataFrame, gold: DataFrame) -> DataFrame:
    """Blocks that meet a gold item, with the gold label and whether theirs is right. A block
    without label counts as an answer, one without confidence as certain."""
    label = F.coalesce("label", F.lit(ANSWER))
    found = best_label(blocks, gold).where(F.col("gold_label").isNotNull())
    return found.select(
        "tag", "doc_id", "ord", label.alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        "gold_label", (label == F.col("gold_label")).alias("correct"), "page", F.substring("text", 1, 120).alias("text"),
    )


def calibration(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count and accuracy per bucket; empty buckets give no row, values outside none count."""
    c = F.col("confidence")
    bucket: Column = F.lit(None)
    for edge, name, mid in BUCKETS:
        inside = F.struct(F.lit(name).alias("bucket"), F.lit(mid).alias("mid"))
        bucket = F.when(c >= edge, inside).otherwise(bucket)
    inside_range = (c >= BUCKETS[0][0]) & (c < TOP_EDGE)
    return rows.where(inside_range).withColumn("b", bucket).groupBy(*keys, "b.bucket", "b.mid").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )


def _mean(correct: bool | None) -> Column:
    return F.avg("confidence") if correct is None else F.avg(F.when(F.col("correct") == correct, F.col("confidence")))


def confidence_table(rows: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """C3"""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), _mean(None).alias("mean_confidence"),
        _mean(True).alias("mean_correct"), _mean(False).alias("mean_incorrect"),
    )


def confidence_sd(rows: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """C4: mean and sample standard deviation by correctness, and the gap between the means."""
    def sd(correct: bool) -> Column:
        return F.stddev_samp(F.when(F.col("correct") == correct, F.col("confidence")))

    return rows.groupBy(*keys).agg(
        _mean(True).alias("mean_correct"), sd(True).alias("sd_correct"), _mean(False).alias("mean_incorrect"),
        sd(False).alias("sd_incorrect"), (_mean(True) - _mean(False)).alias("gap"),
    )


def confidence_band(rows: DataFrame, keys: Sequence[str] = ("tag",), low: float = 0.1, high: float = 0.9) -> DataFrame:
    """The band that holds the middle of the values, by linear interpolation. Equal values are
    counted before the percentile is taken, so a task holds distinct confidences only."""
    counted = rows.groupBy(*keys, "correct", "confidence").agg(F.count("*").alias("_n"))
    band = F.percentile("confidence", F.array(F.lit(low), F.lit(high)), F.col("_n"))
    mean = F.sum(F.col("confidence") * F.col("_n")) / F.sum("_n")
    return counted.groupBy(*keys, "correct").agg(mean.alias("mean"), band.alias("band")).select(
        *keys, "correct", "mean", F.col("band")[0].alias("low"), F.col("band")[1].alias("high")
    )


def case_examples(rows: DataFrame, keys: Sequence[str] = ("tag",), tie: str = "ord") -> DataFrame:
    """For each of high/low confidence and right/wrong the most telling row: the highest of
    the high, the lowest of the low; a placeholder where there is none."""
    high = F.col("confidence") >= HIGH
    w = Window.partitionBy(*keys, "high", "correct").orderBy(
        F.when(high, -F.col("confidence")).otherwise(F.col("confidence")), *( ["doc_id", tie] if tie else [])
    )
    picked = rows.withColumn("high", high).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    # Four cases per key, spread from the keys themselves.
    cases = rows.select(*keys).distinct().select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(h).alias("high"), F.lit(ok).alias("correct"), F.lit(name).alias("case"))
            for h, ok, name in (
                (True, True, "high and right"), (True, False, "high and wrong"),
                (False, True, "low and right"), (False, False, "low and wrong"),
            )
        ])),
    )
    return cases.join(picked.drop("_n"), on=[*keys, "high", "correct"], how="left").select(
        *keys, "case", "confidence", "gold_label", "label",
        F.coalesce(F.substring("text", 1, 64), F.lit("(no items in this case)")).alias("text"),
    )
