"""Confusion counts and everything computed from them.

A confusion is a long table ``(keys..., true_label, pred_label, n)``; ``__missed__`` stands in
the predicted column, ``__no_gold__`` in the true column. One pass over the match rows makes it,
and the metrics below work on that small table with conditional sums. Those that set two runs,
paths or levels side by side (A14, A19, A24, A27, A30) read it twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.labels import LABELS, MISSED, NO_GOLD, NOISE_FLOOR

DOC = ("tag", "doc_id")
RUN = ("tag",)


def short(label: str) -> str:
    """A label as a column name."""
    return label.strip("_").replace(".", "_")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def n_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def is_label(column: str) -> Column:
    return F.col(column).isin(LABELS)


def confusion(matches: DataFrame, keys: Sequence[str] = DOC) -> DataFrame:
    """A1"""
    return matches.select(
        *keys, F.coalesce("gold_label", F.lit(NO_GOLD)).alias("true_label"),
        F.coalesce("pred_label", F.lit(MISSED)).alias("pred_label"),
    ).groupBy(*keys, "true_label", "pred_label").agg(F.count("*").alias("n"))


def pool(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """A2"""
    return conf.groupBy(*keys, "true_label", "pred_label").agg(F.sum("n").alias("n"))


def pool_rollup(conf: DataFrame) -> DataFrame:
    """A2 on both levels: per document, and per run with ``doc_id`` null."""
    return conf.rollup("tag", "true_label", "pred_label", "doc_id").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("level")
    ).where(F.col("level").isin(0, 1)).select("tag", "doc_id", "true_label", "pred_label", "n")


def label_prf(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """A3: precision, recall, F1 and support of each of the five labels."""
    true, pred = F.col("true_label"), F.col("pred_label")
    sums = conf.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(label).alias("label"),
                n_where((true == label) & (pred == label)).alias("tp"),
                n_where((true != label) & (pred == label) & (is_label("true_label") | (true == NO_GOLD))).alias("fp"),
                n_where((true == label) & (pred != label)).alias("fn"),
            ).alias(f"_{i}")
            for i, label in enumerate(LABELS)
        ]
    )
    rows = sums.select(*keys, F.inline(F.array(*[f"_{i}" for i in range(len(LABELS))])))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return rows.select(
        *keys, "label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1"),
        (tp + fn).alias("support"),
    )


def micro_prf(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """A4: predictions without gold count against precision."""
    sums = conf.groupBy(*keys).agg(
        n_where((F.col("true_label") == F.col("pred_label")) & is_label("true_label")).alias("tp"),
        n_where(F.col("pred_label") != MISSED).alias("_pred"),
        n_where(is_label("true_label")).alias("_gold"),
    )
    tp = F.col("tp")
    p, r = ratio(tp, F.col("_pred")), ratio(tp, F.col("_gold"))
    return sums.select(
        *keys, "tp", (F.col("_pred") - tp).alias("fp"), (F.col("_gold") - tp).alias("fn"),
        p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1"),
    )


def gold_metrics(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """A5: predictions without gold are ignored."""
    gold = is_label("true_label")
    return conf.groupBy(*keys).agg(
        n_where(gold & (F.col("true_label") == F.col("pred_label"))).alias("correct"),
        n_where(gold & (F.col("pred_label") != MISSED)).alias("covered"),
        n_where(gold).alias("total_gold"),
    )


def confusion_matrix(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One row per true label that occurs, one column per predicted label and the missed."""
    return conf.where(is_label("true_label")).groupBy(*keys, "true_label").agg(
        *[n_where(F.col("pred_label") == x).alias(short(x)) for x in [*LABELS, MISSED]]
    )


def confusion_pct(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Each cell as a share of all real items of its class."""
    cells = [short(x) for x in [*LABELS, MISSED]]
    total = sum((F.col(c) for c in cells[1:]), F.col(cells[0]))
    m = confusion_matrix(conf, keys)
    return m.select(*keys, "true_label", *[ratio(F.col(c), total).alias(c) for c in cells])


def doc_accuracy(conf: DataFrame, keys: Sequence[str] = DOC) -> DataFrame:
    """Every confusion count is in the total, those without gold too."""
    sums = conf.groupBy(*keys).agg(
        F.sum("n").alias("total"), n_where((F.col("true_label") == F.col("pred_label")) & is_label("true_label")).alias("correct")
    )
    return sums.select(
        *keys, "total", "correct", (F.col("total") - F.col("correct")).alias("errors"),
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        F.concat_ws("/", F.col("correct").cast("string"), F.col("total").cast("string")).alias("formula"),
    )


def errors(matches: DataFrame) -> DataFrame:
    """A10: wrong labels and predictions without gold; texts cut to 120 characters."""
    wrong = F.col("gold_ord").isNull() | (F.col("gold_label") != F.col("pred_label"))
    return matches.where(F.col("pred_ord").isNotNull() & wrong).select(
        "tag", "doc_id", "pred_ord", F.substring("pred_text", 1, 120).alias("text"),
        F.coalesce("gold_label", F.lit("no_gold_match")).alias("true_label"), "pred_label",
    )


def issues(matches: DataFrame) -> DataFrame:
    """Missing, wrong label and extra, as one list."""
    issue = (
        F.when(F.col("pred_ord").isNull(), "missing").when(F.col("gold_ord").isNull(), "extra")
        .when(F.col("gold_label") != F.col("pred_label"), "wrong label")
    )
    return matches.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(
        "tag", "doc_id", F.coalesce("gold_label", F.lit("(none)")).alias("true_label"),
        F.coalesce("pred_label", F.lit("(not produced)")).alias("pred_label"), "issue",
        F.coalesce("pred_text", "gold_text").alias("text"), "gold_ord", "pred_ord",
    )


def issue_counts(listed: DataFrame, keys: Sequence[str] = DOC) -> DataFrame:
    """Documents by kind of issue."""
    return listed.groupBy(*keys).agg(
        *[F.count_if(F.col("issue") == x).alias(x.replace(" ", "_")) for x in ("extra", "missing", "wrong label")]
    )


def off_diagonal(matches: DataFrame) -> DataFrame:
    """Gold items with a wrong label or none, in document and label order."""
    rows = issues(matches).where(F.col("issue") != "extra")
    return rows.select(
        "tag", "doc_id", "true_label",
        F.when(F.col("issue") == "missing", "(not labeled)").otherwise(F.col("pred_label")).alias("pred_label"), "text",
    ).orderBy("tag", "doc_id", "true_label")


def mistake_kinds(errs: DataFrame, n: int, keys: Sequence[str] = RUN) -> DataFrame:
    """The *n* most frequent (true -> predicted) kinds per run; a top-k report."""
    kinds = errs.groupBy(*keys, "true_label", "pred_label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "true_label", "pred_label")
    return kinds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mistake_change(a: DataFrame, b: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Mistakes of two paths by kind, and the change."""
    on = [*keys, "true_label", "pred_label"]
    left = a.groupBy(*on).agg(F.count("*").alias("path_a"))
    right = b.groupBy(*on).agg(F.count("*").alias("path_b"))
    zero = F.lit(0)
    return left.join(right, on=on, how="full").select(
        *on, F.coalesce("path_a", zero).alias("path_a"), F.coalesce("path_b", zero).alias("path_b"),
        (F.coalesce("path_b", zero) - F.coalesce("path_a", zero)).alias("change"),
    )


def missing_share(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Share of each label's items that nothing claimed, one column per label; null where
    none is missing."""
    gold, gone = is_label("true_label"), F.col("pred_label") == MISSED
    share = [
        F.nullif(ratio(n_where(gone & (F.col("true_label") == x)), n_where(F.col("true_label") == x)), F.lit(0.0)).alias(short(x))
        for x in LABELS
    ]
    return conf.where(gold).groupBy(*keys).agg(*share)


def missing_by_doc(conf: DataFrame) -> DataFrame:
    """Missing items per document and label, all runs pooled, with the total."""
    return conf.where(is_label("true_label") & (F.col("pred_label") == MISSED)).groupBy("doc_id").agg(
        *[n_where(F.col("true_label") == x).alias(short(x)) for x in LABELS], F.sum("n").alias("total")
    )


def top_share(by_doc: DataFrame, k: int = 2) -> DataFrame:
    """How much of all missing items the *k* worst documents hold."""
    top = by_doc.select("total").orderBy(F.desc("total")).limit(k).agg(F.sum("total").alias("top_total")).scalar()
    return by_doc.agg(F.sum("total").alias("total")).select(
        top.alias("top_total"), "total", ratio(top, F.col("total")).alias("share")
    )


def check_rows(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """The sum of every row's shares; 1 unless a label outside the five was predicted."""
    rows = conf.where(is_label("true_label")).groupBy(*keys, "true_label").agg(
        F.sum("n").alias("row_total"), n_where(F.col("pred_label").isin([*LABELS, MISSED])).alias("_known")
    )
    share = ratio(F.col("_known"), F.col("row_total"))
    return rows.select(*keys, "true_label", "row_total", share.alias("row_sum"), (F.abs(share - 1) < 1e-9).alias("ok"))


def macro_f1(conf: DataFrame, keys: Sequence[str] = RUN, doc: str = "doc_id") -> DataFrame:
    """F1 per document and label, averaged over the documents in which the label is present
    or predicted; population standard deviation."""
    per_doc = label_prf(conf, [*keys, doc]).where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return per_doc.groupBy(*keys, "label").agg(
        F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("sd_f1"), F.count("*").alias("n_docs")
    )


def class_report(conf: DataFrame, tags: Sequence[str]) -> DataFrame:
    """F1 of each class, runs side by side, with support and a micro-average row."""
    per = label_prf(conf).select("tag", "label", "f1", "support")
    micro = micro_prf(conf).select("tag", F.lit("micro avg").alias("label"), "f1", (F.col("tp") + F.col("fn")).alias("support"))

    def of(tag: str, column: str) -> Column:
        return F.max(F.when(F.col("tag") == tag, F.col(column)))

    return per.unionByName(micro).groupBy("label").agg(of(tags[0], "support").alias("support"), *[of(t, "f1").alias(t) for t in tags])


def doc_f1_matrix(conf: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Micro F1 of every document, runs side by side."""
    per = micro_prf(conf, DOC)
    return per.groupBy("doc_id").agg(*[F.max(F.when(F.col("tag") == t, F.col("f1"))).alias(t) for t in tags])


def perfect_docs(conf: DataFrame) -> DataFrame:
    """Documents with a perfect score, per run, one row each."""
    return micro_prf(conf, DOC).where(F.col("f1") == 1.0).select("tag", "doc_id")


def restrict(conf: DataFrame, docs: DataFrame) -> DataFrame:
    """A21"""
    return conf.join(docs.select("doc_id").distinct(), on="doc_id", how="left_semi")


def score_delta(new: DataFrame, base: DataFrame, keys: Sequence[str] = RUN, floor: float = NOISE_FLOOR) -> DataFrame:
    """Change of F1 against a baseline; null without one."""
    change = F.col("f1") - F.col("base_f1")
    return new.select(*keys, "f1").join(base.select(*keys, F.col("f1").alias("base_f1")), on=list(keys), how="left").select(
        *keys, "f1", "base_f1", change.alias("change"), (F.abs(change) < floor).alias("is_noise")
    )


def label_destinations(conf: DataFrame, label: str, keys: Sequence[str] = RUN) -> DataFrame:
    """Where the items of one true label went, most frequent first."""
    return pool(conf.where(F.col("true_label") == label), keys).where("n > 0").select(*keys, "pred_label", "n").orderBy(
        *keys, F.desc("n"), "pred_label"
    )


def run_spread(scores: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Largest minus smallest value over repeated runs, and the mean, of each column."""
    return scores.groupBy(*keys).agg(
        *[x for c in columns for x in ((F.max(c) - F.min(c)).alias(f"{c}_spread"), F.avg(c).alias(f"{c}_mean"))]
    )


def rank_runs(conf: DataFrame, by: str = "block_acc", keys: Sequence[str] = RUN) -> DataFrame:
    """Runs by block accuracy (all rows) or gold accuracy, best first, each best marked."""
    blocks = doc_accuracy(conf, keys).select(*keys, "correct", "total", F.col("accuracy").alias("block_acc"))
    gold = gold_metrics(conf, keys).select(
        *keys, F.col("correct").alias("gold_correct"), F.col("total_gold").alias("gold_total"),
        ratio(F.col("correct"), F.col("total_gold")).alias("gold_acc"),
    )
    runs = blocks.join(gold, on=list(keys))
    best_block, best_gold = (runs.agg(F.max(c)).scalar() for c in ("block_acc", "gold_acc"))
    return runs.select(
        *keys, "correct", "total", "block_acc", "gold_correct", "gold_total", "gold_acc",
        (F.col("block_acc") == best_block).alias("best_block"), (F.col("gold_acc") == best_gold).alias("best_gold"),
    ).orderBy(F.desc(by), *keys)


def experiment_summary(acc: DataFrame, models: Sequence[str], extractors: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """A line per model, extractor and path of a run matrix, also for runs without results.

    *acc* holds ``(tag, path, doc_id, correct, total)``; the matrix itself is a short list of
    configured names.
    """
    grid = [
        (m, e, p, f"{m.replace(':', '-')}_{e}_whole_doc") for m in models for e in extractors for p in paths
    ]
    cells = acc.sparkSession.createDataFrame(grid, "model string, extractor string, path string, tag string")
    sums = acc.groupBy("tag", "path").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return cells.join(sums, on=["tag", "path"], how="left").select(
        "model", "extractor", "path", "tag", F.coalesce("correct", F.lit(0)).alias("correct"),
        F.coalesce("total", F.lit(0)).alias("total"), F.try_divide("correct", "total").alias("accuracy"),
        F.col("total").isNotNull().alias("has_results"),
    )


def consistency_report(runs: DataFrame, scores: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Blocks given, label runs and F1 per run, from B8 per document and A4."""
    counted = runs.groupBy(*keys).agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_runs").alias("n_changes"))
    return counted.join(scores.select(*keys, "f1"), on=list(keys)).select(
        *keys, "n_blocks", "n_changes", ratio(F.col("n_changes"), F.col("n_blocks")).alias("changes_per_block"), "f1"
    )


def report(conf: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Per-label rows, then micro, macro and support-weighted averages."""
    per = label_prf(conf, keys).select(*keys, F.col("label").alias("row"), "precision", "recall", "f1", "support")
    support = F.sum("support").alias("support")
    macro = per.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], support)
    weighted = per.groupBy(*keys).agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], support
    )
    micro = micro_prf(conf, keys).select(*keys, "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
    out = per
    for name, rows in (("micro avg", micro), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(rows.withColumn("row", F.lit(name)))
    return out
