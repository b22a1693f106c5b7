"""Matching items by token containment: best gold for a block, one-to-one claims, grounding.

Containment of left in right is the share of left's distinct tokens that occur in right. Pairs of
token sets come from `set_join`; equal sets are compared once, however many rows bear them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.text import letters_and_digits, n_among
from docstruct.labels import CONTAINMENT_THRESHOLD
from docstruct.operators.set_join import needed, set_pairs, token_sets, with_tokens
from docstruct.session import cut_lineage

MATCH_COLUMNS = ["gold_ord", "gold_text", "gold_label", "pred_ord", "pred_text", "pred_label"]


def best_match(
    left: DataFrame, right: DataFrame, on: Sequence[str], threshold: float | Column, keep: Sequence[str] = ("label",)
) -> DataFrame:
    """Every row of *left* with its best row of *right* on the same *on*: highest containment,
    first ``ord`` on ties, null below *threshold*. Adds ``toks, n_toks, set, score, gold_ord`` and
    ``gold_<keep>``. *threshold* may be a column of *left*: the least number of shared tokens."""
    l, r = with_tokens(left), with_tokens(right)
    need = threshold if isinstance(threshold, Column) else needed(F.col("n_toks"), threshold)
    first = F.min(F.struct("ord", *keep)).alias("first")
    pairs = set_pairs(token_sets(l.withColumn("need", need), on, F.min("need").alias("need")), token_sets(r, on, first), on, keep=["first"])
    best = pairs.groupBy(*on, F.col("lset").alias("set")).agg(
        F.max_by(F.struct("score", "first"), F.struct("score", (-F.col("first.ord")).alias("neg"))).alias("b")
    )
    chosen = best.select(
        *on, "set", F.col("b.score").alias("score"), F.col("b.first.ord").alias("gold_ord"), *[F.col(f"b.first.{k}").alias(f"gold_{k}") for k in keep]
    )
    return l.join(chosen, on=[*on, "set"], how="left")


def best_label(blocks: DataFrame, gold: DataFrame, threshold: float = CONTAINMENT_THRESHOLD) -> DataFrame:
    """M3: ``gold_label`` for each block ``(tag, doc_id, ord, text, label)``, null below threshold."""
    return best_match(blocks, gold, ["doc_id"], threshold).drop("toks", "set")


def true_label(items: DataFrame, gold: DataFrame, threshold: float = CONTAINMENT_THRESHOLD) -> DataFrame:
    """M7: as M3, but items of fewer than three tokens have no true label."""
    found = best_match(items, gold, ["doc_id"], threshold)
    return found.withColumn("true_label", F.when(F.col("n_toks") >= 3, F.col("gold_label"))).drop("toks", "set", "gold_label")


def true_label_strict(blocks: DataFrame, gold: DataFrame, threshold: float = CONTAINMENT_THRESHOLD, other: float = 0.9) -> DataFrame:
    """M8: M7, and null too when the block also holds (>= *other*) a different gold item of two
    tokens or more. A gold token set shared by several items always holds a different one."""
    found = best_match(blocks, gold, ["doc_id"], threshold, keep=("label", "set"))
    sets = token_sets(with_tokens(gold).where("n_toks >= 2"), ["doc_id"], F.count("*").alias("n_rows"))
    sets = sets.withColumn("need", needed(F.col("n_toks"), other))
    held = set_pairs(sets, token_sets(with_tokens(blocks), ["doc_id"]), ["doc_id"], keep=["n_rows"])
    spans = held.groupBy("doc_id", F.col("rset").alias("set")).agg(
        F.min("lset").alias("low"), F.max("lset").alias("high"), F.max("n_rows").alias("most")
    )
    # Some set differs from the best item's own if the smallest or the largest does.
    two = (F.col("most") > 1) | (F.col("low") != F.col("gold_set")) | (F.col("high") != F.col("gold_set"))
    known = (F.col("n_toks") >= 3) & F.col("gold_label").isNotNull() & ~F.coalesce(two, F.lit(False))
    return found.join(spans, on=["doc_id", "set"], how="left").withColumn(
        "true_label", F.when(known, F.col("gold_label"))
    ).drop("toks", "set", "gold_set", "low", "high", "most", "gold_label")


def block_accuracy(labeled: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """M9: correct, wrong and share over blocks that have a true label."""
    known = labeled.where(F.col("true_label").isNotNull())
    right = F.col("label").eqNullSafe(F.col("true_label"))
    return known.groupBy(*keys).agg(
        F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"), F.avg(right.cast("double")).alias("accuracy")
    )


def near_misses(pred: DataFrame, gold: DataFrame, low: float = 0.75, high: float = 1.0) -> DataFrame:
    """Predictions whose best containment lies in [low, high), with the words that cost them."""
    found = best_match(pred, gold, ["doc_id"], low, keep=("toks",)).where(F.col("score") < high)
    extra = F.array_join(F.array_sort(F.array_except("toks", "gold_toks")), ", ")
    return found.withColumn("extra_words", extra).drop("toks", "set", "gold_toks")


def near_miss_buckets(misses: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """M11"""
    return misses.groupBy(*keys).agg(
        F.count_if(F.col("score") >= 0.95).alias("few_words"), F.count_if(F.col("score") < 0.95).alias("fused"),
    )


def closest(gold: DataFrame, pred: DataFrame, k: int = 3) -> DataFrame:
    """The *k* predictions of each run closest to every given gold item.

    Predictions that share no word score 0 and follow in document order, so only the first *k*
    of a document can be among them; of equal token sets only the first *k* rows can matter.
    """
    p, g = with_tokens(pred), with_tokens(gold)
    place = Window.partitionBy("tag", "doc_id").orderBy("ord")
    copies = Window.partitionBy("tag", "doc_id", "set").orderBy("ord")
    few = p.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k).drop("_c")
    words = g.select("doc_id", F.col("ord").alias("gold_ord"), F.explode("toks").alias("tok"))
    sharing = few.select("tag", "doc_id", "ord", "n_toks", F.explode("toks").alias("tok")).join(words, on=["doc_id", "tok"])
    scored = sharing.groupBy("tag", "doc_id", "gold_ord", "ord", "n_toks").agg(F.count("*").alias("n")).select(
        "tag", "doc_id", "gold_ord", "ord", (F.col("n") / F.col("n_toks")).alias("score")
    )
    first = p.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k)
    filler = first.select("tag", "doc_id", "ord").join(g.select("doc_id", F.col("ord").alias("gold_ord")), on="doc_id")
    pool = scored.unionByName(filler.withColumn("score", F.lit(0.0))).groupBy("tag", "doc_id", "gold_ord", "ord").agg(
        F.max("score").alias("score")
    )
    near = Window.partitionBy("tag", "doc_id", "gold_ord").orderBy(F.desc("score"), "ord")
    top = pool.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return top.join(p.select("tag", "doc_id", "ord", "text", "label"), on=["tag", "doc_id", "ord"])


def swallowed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Predictions that hold every word of a gold item, with the gold item they score best
    against (of any score). Gold items without words are left out.

    A prediction shares all words of an item that it holds, so its best item shares as many at least.
    """
    g, p = with_tokens(gold), with_tokens(pred)
    on = ["doc_id"]
    holds = set_pairs(token_sets(g, on).withColumn("need", F.col("n_toks")), token_sets(p, on), on)
    inside = g.select("doc_id", F.col("ord").alias("gold_ord"), F.col("label").alias("gold_label"), F.col("set").alias("lset"))
    pairs = holds.join(inside, on=["doc_id", "lset"]).select("doc_id", F.col("rset").alias("set"), "gold_ord", "gold_label")
    most = holds.groupBy("doc_id", F.col("rset").alias("set")).agg(F.max("shared").alias("held"))
    some = p.join(most, on=["doc_id", "set"]).select(*pred.columns, "held")
    best = best_match(some, gold, on, F.col("held")).select(
        "tag", "doc_id", "ord", "set", "label", "score",
        F.col("gold_ord").alias("best_ord"), F.col("gold_label").alias("best_label"),
    )
    return best.join(pairs, on=["doc_id", "set"]).drop("set")


def heading_hits(pred: DataFrame, gold: DataFrame, label: str, threshold: float = CONTAINMENT_THRESHOLD) -> DataFrame:
    """Produced headings found in any gold heading of the document, per run."""
    heads = best_match(pred.where(F.col("label") == label), gold.where(F.col("label") == label), ["doc_id"], threshold)
    return heads.groupBy("tag").agg(
        F.count("*").alias("n_headings"), F.count_if(F.col("gold_label").isNotNull()).alias("n_hits")
    )


def containment_join(left: DataFrame, right: DataFrame, threshold: float = CONTAINMENT_THRESHOLD) -> DataFrame:
    """All pairs ``(left_id, right_id, score)`` across two tables ``(id, text)``.

    The work is done on distinct token sets; ids come back by two equality joins at the end.
    """
    l, r = with_tokens(left), with_tokens(right)
    sets = token_sets(l, []).withColumn("need", needed(F.col("n_toks"), threshold))
    pairs = set_pairs(sets, token_sets(r, []), [], rarest=True)
    return (
        pairs.join(l.select(F.col("id").alias("left_id"), F.col("set").alias("lset")), on="lset")
        .join(r.select(F.col("id").alias("right_id"), F.col("set").alias("rset")), on="rset")
        .select("left_id", "right_id", "score")
    )


# ---- one-to-one claims -------------------------------------------------------------------


def greedy_match(gold: DataFrame, pred: DataFrame, threshold: float = CONTAINMENT_THRESHOLD, *, docs: DataFrame | None = None) -> DataFrame:
    """M4-M6: gold items ``(doc_id, ord, text, label)`` in order each claim the best unclaimed
    prediction ``(tag, doc_id, ...)`` of every run; first on ties, at or above *threshold*.

    One row per gold item (pred side null = missed) and per unclaimed prediction (gold side
    null). Runs and documents scored are those in *docs* ``(tag, doc_id)``; by default those on
    both sides.

    Both sides are computed once and kept (`cut_lineage`). Candidates are pairs of token sets, found
    by joins. Who claims what follows from the order of the gold items alone, so it is a fold: sorted
    rows of identifiers, without texts, pass through a task once, and only the open predictions of
    the document at hand are held.
    """
    doc = ["tag", "doc_id"]
    g = cut_lineage(with_tokens(gold.select("doc_id", "ord", "text", "label")))
    p = cut_lineage(with_tokens(pred.select(*doc, "ord", "text", "label")))
    if docs is None:
        docs = p.select(*doc).distinct().join(g.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = docs.select(*doc).distinct()
    p = p.join(docs, doc, "left_semi")
    sets = token_sets(p, ["doc_id"]).withColumn("need", needed(F.col("n_toks"), threshold))
    pairs = set_pairs(sets, token_sets(g, ["doc_id"]), ["doc_id"])
    open_ = p.where("n_toks > 0").select(*doc, "ord", "set")
    wishes = (
        pairs.join(g.select("doc_id", F.col("ord").alias("gold_ord"), F.col("set").alias("rset")), ["doc_id", "rset"])
        .join(open_.select(*doc, F.col("set").alias("lset")).distinct(), ["doc_id", "lset"])
    )
    nobody = F.lit(None).cast("bigint")
    rows = open_.select(*doc, nobody.alias("gold_ord"), F.lit(0.0).alias("score"), F.col("ord").cast("bigint").alias("pred_ord"), "set").unionByName(
        wishes.select(*doc, F.col("gold_ord").cast("bigint").alias("gold_ord"), "score", nobody.alias("pred_ord"), F.col("lset").alias("set"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    claims = (
        rows.repartition(*doc).sortWithinPartitions(*doc, F.asc_nulls_first("gold_ord"), F.desc("score"), "pred_ord")
        .mapInArrow(_claims, f"tag {kinds['tag']}, doc_id {kinds['doc_id']}, gold_ord bigint, pred_ord bigint")
    )
    gold_side = docs.join(g.select("doc_id", *[F.col(c).alias(f"gold_{c}") for c in ("ord", "text", "label")]), "doc_id")
    pred_side = p.select(*doc, *[F.col(c).alias(f"pred_{c}") for c in ("ord", "text", "label")])
    return gold_side.join(claims, [*doc, "gold_ord"], "left").join(pred_side, [*doc, "pred_ord"], "full").select(*doc, *MATCH_COLUMNS)


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims of sorted rows: per document first its open predictions, then the wishes of each
    gold item, best score first. Predictions of one set are claimed in their order."""
    at: tuple | None = None
    open_: dict[bytes, list[int]] = {}  # by set: open predictions, the next one last
    gold, tied, best = None, [], None  # the gold item at hand, the sets it likes best
    out: list[tuple] = []

    def settle() -> None:
        nonlocal gold
        if gold is not None and tied:
            chosen = min(tied, key=lambda s: open_[s][-1])
            out.append((*at, gold, open_[chosen].pop()))
        gold = None

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("tag", "doc_id", "gold_ord", "score", "pred_ord", "set")]
        for tag, doc_id, wish, score, prediction, of in zip(*columns):
            if at != (tag, doc_id):
                settle()
                at, open_, turned = (tag, doc_id), {}, False
            if wish is None:
                open_.setdefault(of, []).append(prediction)
                continue
            if not turned:  # predictions came in rising order
                turned = True
                for some in open_.values():
                    some.reverse()
            if wish != gold:
                settle()
                gold, tied, best = wish, [], None
            if open_.get(of) and (best is None or score == best):
                best = score
                tied.append(of)
        names = ["tag", "doc_id", "gold_ord", "pred_ord"]
        done, out = out, []
        columns = list(zip(*done)) if done else [(), (), (), ()]
        types = [batch.schema.field("tag").type, batch.schema.field("doc_id").type, pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    settle()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def missed(matches: DataFrame) -> DataFrame:
    """M6"""
    return matches.where(F.col("pred_ord").isNull())


def unclaimed(matches: DataFrame) -> DataFrame:
    """M5"""
    return matches.where(F.col("gold_ord").isNull())


# ---- grounding ---------------------------------------------------------------------------

# Fields whose values are codes or dates, which no text can ground.
NOT_CHECKED = [
    "type", "data_access", "personal_data", "sensitive_data", "ethical_issues_exist", "language",
    "funding_status", "is_reused", "certified_with", "pid_system", "support_versioning", "geo_location",
    "storage_type", "availability", "backup_type", "backup_frequency", "currency_code", "role",
    "created", "modified", "issued", "start", "end", "start_date", "available_until",
]
# Texts that say a value is not known.
PLACEHOLDERS = [
    "unknown", "not specified", "n/a", "na", "none", "not applicable", "not provided", "null",
    "not available", "tbd", "unspecified", "not stated", "not mentioned",
]


def grounding(values: DataFrame, docs: DataFrame) -> DataFrame:
    """Is each ``value`` found in its document's text? Adds ``grounding``.

    Found means: as a normalised substring, or at least 80% of its words of three or more
    letters occur in the text. The text is taken into words once per value that is no substring
    of it, and those of the value among them are picked out through a hash.
    """
    flat = docs.select("doc_id", letters_and_digits(F.col("text")).alias("flat"))
    v = letters_and_digits(F.col("value"))
    words = F.filter(F.split("norm", " "), lambda w: F.length(w) > 2)
    known = n_among(F.col("words"), F.split(F.coalesce("flat", F.lit("")), " "))
    verdict = (
        F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty")
        .when(F.col("norm").isin(PLACEHOLDERS), "placeholder")
        .when((F.col("norm") != "") & F.contains(F.coalesce("flat", F.lit("")), "norm"), "grounded")
        .when((F.size("words") > 0) & (known / F.size("words") >= 0.8), "grounded")
        .otherwise("invented")
    )
    # The texts may be more than a guess of their size says: none go through the driver.
    both = values.withColumn("norm", v).join(flat.hint("merge"), on="doc_id", how="left").withColumn("words", words)
    return both.withColumn("grounding", verdict).drop("flat", "norm", "words")


REPORT_PARTS = 4096  # parts of the documents whose first examples are gathered apart


def grounding_report(grounded: DataFrame, keys: Sequence[str] = ("run", "model"), show: int = 3) -> DataFrame:
    """Counts per verdict, share grounded among values that are not empty, and up to *show*
    invented values (the first in document and path order).

    Counts and examples come from one pass: per document, per part of the documents, per *keys*; what is
    collected is a document's invented values, then the first of a part's, then the first of all parts.
    """
    verdicts = ["grounded", "invented", "placeholder", "empty"]

    def first(found: Column) -> Column:
        return F.slice(F.sort_array(found), 1, show)

    invented = F.when(F.col("grounding") == "invented", F.struct("doc_id", "path", "value"))
    per_doc = grounded.groupBy(*keys, "doc_id").agg(
        *[F.count_if(F.col("grounding") == v).alias(v) for v in verdicts], first(F.collect_list(invented)).alias("x")
    )
    sums = [*[F.sum(v).alias(v) for v in verdicts], first(F.flatten(F.collect_list("x"))).alias("x")]
    parts = per_doc.groupBy(*keys, F.pmod(F.xxhash64("doc_id"), F.lit(REPORT_PARTS)).alias("_part")).agg(F.count("doc_id").alias("samples"), *sums)
    counts = parts.groupBy(*keys).agg(F.sum("samples").alias("samples"), *sums)
    written = F.col("grounded") + F.col("invented") + F.col("placeholder")
    example = F.transform("x", lambda e: F.concat(e["doc_id"].cast("string"), F.lit(" "), e["path"], F.lit(" = "), F.substring(e["value"], 1, 70)))
    return counts.select(
        *keys, "samples", "grounded", "invented", "placeholder", "empty",
        F.coalesce(F.try_divide("grounded", written), F.lit(0.0)).alias("share_grounded"),
        F.coalesce(F.array_join(example, "; "), F.lit("")).alias("examples"),
    )
