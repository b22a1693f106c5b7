"""Comparing nested JSON records field by field.

Records are JSON text, one per row. `trees` takes them apart into rows; a record and its reference
are walked together, list items paired on the way, so judging needs no join of fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from docstruct.functions.json_text import last_values
from docstruct.functions.text import (
    bare_path, containment, field_kind, is_empty_value, norm_date, norm_id, norm_text, tokens,
)
from docstruct.labels import CONTAINMENT_THRESHOLD
from docstruct.operators.trees import key_counts, leaf_rows, list_keys, list_pairs, nodes, paired_leaves

RECORD = ("run", "model", "doc_id")
VERDICTS = ["Correct", "Hallucinated", "Missed"]
OUTCOMES = ["Correct", "Mismatch", "Missed"]

# ---- taking records apart ----------------------------------------------------------------


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _spread_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records evenly over ``spark.sql.shuffle.partitions`` tasks. Taking a record apart costs far
    more than moving it, and a fixed number of partitions is not merged again by its bytes; the
    keys name one record, so a document with many records is spread too."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)


def _spread_rows(records: DataFrame) -> DataFrame:
    """`_spread_out` where no keys are named: by all texts and numbers of the row."""
    return _spread_out(records, [f.name for f in records.schema if isinstance(f.dataType, (StringType, NumericType))])


def record_nodes(records: DataFrame, raw: str = "raw", keys: Sequence[str] = RECORD) -> DataFrame:
    """Every node of every record, containers included (see `trees.nodes`)."""
    return nodes(_spread_out(records.select(*keys, raw), keys), raw, keys)


def leaves(records: DataFrame, raw: str = "raw", keys: Sequence[str] = RECORD) -> DataFrame:
    """``(keys, path, value)`` of every scalar; J2 is applied on the way down. The root is an
    object; rows that hold no valid JSON give nothing (see `split_invalid`)."""
    return leaf_rows(_spread_out(records.select(*keys, raw), keys), raw, keys)


def _with_reference(records: DataFrame, references: DataFrame, raw: str, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """``(keys, _raw, _ref)``: records beside the reference of their document. There is a reference to every
    document, and the size of texts that a query makes is guessed far too low: without the hint the guess
    sends all of them through the driver."""
    ref = references.select(*on, F.col(raw).alias("_ref")).hint("merge")
    return records.select(*keys, F.col(raw).alias("_raw")).join(ref, on=list(on)).select(*keys, "_raw", "_ref")


def paired_fields(
    records: DataFrame, references: DataFrame, raw: str = "raw", keys: Sequence[str] = RECORD, on: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The leaves of *records* ``(keys, raw)`` and of the document's reference ``(on, raw)``, met
    field by field: ``path`` on the reference's indices, ``mpath`` as written (null where only the
    reference has the field), ``value``, ``ref_value``. One walk of both; no join of leaves."""
    return paired_leaves(_spread_out(_with_reference(records, references, raw, keys, on), keys), keys)


def aligned_leaves(
    records: DataFrame, references: DataFrame, raw: str = "raw", keys: Sequence[str] = RECORD, on: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Leaves of *records* with ``path`` on the indices of the document's reference and
    ``mpath`` as written."""
    return paired_fields(records, references, raw, keys, on).where("mpath IS NOT NULL").drop("ref_value")


def item_keys(records: DataFrame, at: str, raw: str = "raw", keys: Sequence[str] = RECORD) -> DataFrame:
    """``(keys, item, item_keys)`` of the items of the list at the dotted path *at*."""
    return list_keys(records, raw, keys, at)


def pair_items(
    records: DataFrame, references: DataFrame, at: str, raw: str = "raw", keys: Sequence[str] = RECORD, on: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``(keys, mapping)``, the reference index of every item of the record's list at *at*."""
    return list_pairs(_spread_out(_with_reference(records, references, raw, keys, on), keys), keys, at)


def key_census(records: DataFrame, raw: str = "raw", pattern: str | None = None) -> DataFrame:
    """How often each key occurs at any depth, containers included; *pattern* keeps the keys
    that match it, whatever their case."""
    counted = key_counts(_spread_rows(records), raw).groupBy("key").agg(F.sum("n").alias("n"))
    return counted if pattern is None else counted.where(F.col("key").rlike(f"(?i){pattern}"))


def split_invalid(records: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(valid records, rows whose text is no JSON object, with a reason). Repeated keys are no fault."""
    parsed = F.try_parse_json("_text")
    reason = F.when(parsed.isNull(), "not valid JSON").when(_as_map(parsed).isNull(), "not a JSON object")
    read = _spread_rows(records).withColumn("_text", last_values(F.col(raw), movable=False))
    marked = read.withColumn("reason", reason).drop("_text")
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def merge_records(first: DataFrame, second: DataFrame, key: str = "doc_id", raw: str = "raw") -> DataFrame:
    """One object per document with *first*'s top-level keys, then *second*'s. A document
    that lacks a side, whose side is no JSON object, or whose sides share a key, gets a reason
    instead of a merged text."""
    a = first.select(key, F.col(raw).alias("a"))
    b = second.select(key, F.col(raw).alias("b"))
    shared = F.array_sort(F.array_intersect(F.json_object_keys("a"), F.json_object_keys("b")))
    body_a = F.regexp_replace("a", r"(?s)^\s*\{|\}\s*$", "")
    body_b = F.regexp_replace("b", r"(?s)^\s*\{|\}\s*$", "")
    glue = F.when((F.trim(body_a) != "") & (F.trim(body_b) != ""), F.lit(", ")).otherwise(F.lit(""))
    reason = (
        F.when(F.col("a").isNull(), "no first record").when(F.col("b").isNull(), "no second record")
        .when(_as_map(F.try_parse_json("a")).isNull(), "first record is not an object")
        .when(_as_map(F.try_parse_json("b")).isNull(), "second record is not an object")
        .when(F.size(shared) > 0, F.concat(F.lit("shared keys: "), F.array_join(shared, ", ")))
    )
    merged = F.concat(F.lit("{"), body_a, glue, body_b, F.lit("}"))
    return a.join(b, on=key, how="full").withColumn("reason", reason).select(
        key, F.when(F.col("reason").isNull(), merged).alias("merged"), "reason"
    )


# ---- judging -----------------------------------------------------------------------------


def verdict(path: Column, model: Column, ref: Column) -> Column:
    """struct(verdict, reason) for the values of one field, as text."""
    m_empty, r_empty = is_empty_value(model), is_empty_value(ref)
    kind = field_kind(path)
    share = containment(tokens(model), tokens(ref))
    percent = F.concat(
        F.lit("only "), F.bround(share * 100, 0).cast("int").cast("string"), F.lit("% of the model's words are in the reference")
    )

    def say(v: str, why: Column | str) -> Column:
        return F.struct(F.lit(v).alias("verdict"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))

    def judged(same: Column, why: Column | str) -> Column:
        return F.when(same, say("Correct", "")).otherwise(say("Hallucinated", why))

    return (
        # Equal values with a letter or digit pass under every kind; most fields end here.
        F.when((model == ref) & model.rlike("[A-Za-z0-9]") & ~m_empty, say("Correct", ""))
        .when(m_empty & r_empty, say("Correct", "both empty"))
        .when(m_empty, say("Hallucinated", "empty where the reference has a value"))
        .when(r_empty, say("Hallucinated", "not in the reference"))
        .when(kind == "identifier", judged(norm_id(model) == norm_id(ref), "identifier differs"))
        .when(kind == "date", judged(norm_date(model) == norm_date(ref), "different day"))
        .when(kind == "controlled", judged(norm_text(model) == norm_text(ref), "different value"))
        .otherwise(judged(share >= CONTAINMENT_THRESHOLD, percent))
    )


def judge(
    records: DataFrame, references: DataFrame, raw: str = "raw", keys: Sequence[str] = RECORD, on: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """A row per field the record wrote, and a Missed row per reference field that no
    Correct row covers. A wrong value therefore gives two rows.

    A record's paths are unique, so each field that it shares with its reference decides both of its
    rows by itself. Records that are no JSON object, or whose document has no reference, give none.
    """
    both = paired_fields(records, references, raw, keys, on).withColumnsRenamed(
        {"path": "field", "mpath": "model_field", "value": "model_value", "ref_value": "reference_value"}
    )
    written = F.col("model_field").isNotNull()
    both = both.withColumn("_v", F.when(written, verdict(F.col("field"), F.col("model_value"), F.col("reference_value"))))
    missed = ~is_empty_value(F.col("reference_value")) & ~(written & (F.col("_v.verdict") == "Correct"))
    # Which rows a field gives, as a constant list: a list of structs would be built and read value by value.
    sides = F.when(written & missed, F.array(F.lit("wrote"), F.lit("missed"))).when(written, F.array(F.lit("wrote"))).when(missed, F.array(F.lit("missed")))
    out = both.withColumn("_side", F.explode(sides))
    wrote = F.col("_side") == "wrote"
    return out.select(
        *keys, "field", *[F.when(wrote, F.col(c)).alias(c) for c in ("model_field", "model_value")], "reference_value",
        F.when(wrote, F.col("_v.verdict")).otherwise("Missed").alias("verdict"), F.when(wrote, F.col("_v.reason")).otherwise("").alias("reason"),
    )


def n_reference_fields(ref_leaves: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """J13"""
    return ref_leaves.where(~is_empty_value(F.col("value"))).groupBy(*keys).agg(F.count_distinct("path").alias("n_ref"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _n(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == value)


def _with_scores(counts: DataFrame, found: Column) -> DataFrame:
    p = _ratio(F.col("correct"), F.col("correct") + F.col("hallucinated"))
    r = _ratio(found, F.col("n_ref"))
    return counts.withColumns(
        {"precision": F.round(p, 3), "recall": F.round(r, 3), "f1": F.round(_ratio(2 * p * r, p + r), 3)}
    )


def field_metrics(judged: DataFrame, n_ref: DataFrame, keys: Sequence[str] = RECORD, on: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per record; both-empty fields count as correct here."""
    counts = judged.groupBy(*keys).agg(*[_n("verdict", v).alias(v.lower()) for v in VERDICTS])
    counts = counts.join(n_ref.hint("merge"), on=list(on), how="left").withColumn("n_ref", F.coalesce("n_ref", F.lit(0)))
    counts = counts.withColumn("written", F.col("correct") + F.col("hallucinated"))
    return _with_scores(counts, F.col("n_ref") - F.col("missed"))


def field_outcomes(judged: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Annotated field -> Correct, Mismatch or Missed."""
    wrote_other = (F.col("verdict") == "Hallucinated") & (F.col("reason") != "empty where the reference has a value")
    outcome = (
        F.when(F.bool_or(F.col("verdict") == "Correct"), "Correct").when(F.bool_or(wrote_other), "Mismatch").otherwise("Missed")
    )
    annotated = judged.where(~is_empty_value(F.col("reference_value")))
    return annotated.groupBy(*keys, "field").agg(outcome.alias("outcome"))


# ---- the form ----------------------------------------------------------------------------

# Path prefix (without indices and the leading "dmp.") -> section and row of the
# form, first match wins; "=" marks a whole path. Order of the rows as printed.
FORM_RULES = [
    ("=title", "Plan", "Plan title & description"), ("=description", "Plan", "Plan title & description"),
    ("contact", "Contact", "Contact person"), ("contributor", "People & project", "Contributors"),
    ("project", "People & project", "Project & funding"),
    ("dataset.distribution.data_access", "Storage & licence", "Data access"),
    ("dataset.distribution.host", "Storage & licence", "Storage place (host)"),
    ("dataset.distribution.license", "Storage & licence", "Licence"),
    ("dataset.distribution", "Storage & licence", "Other distribution details"),
    ("dataset.metadata", "Metadata", "Metadata & standards"),
    ("=dataset.title", "Datasets", "Dataset title"), ("=dataset.description", "Datasets", "Dataset description"),
    ("=dataset.type", "Datasets", "Dataset type"),
    ("=dataset.personal_data", "Datasets", "Personal & sensitive data"),
    ("=dataset.sensitive_data", "Datasets", "Personal & sensitive data"),
    ("dataset", "Datasets", "Dataset identifier & dates"),
]
FORM_OTHER = ("Plan", "Plan details (dates, ID, language, ethics)")
FORM_ROWS = [
    "Plan title & description", "Plan details (dates, ID, language, ethics)", "Contact person", "Dataset title",
    "Dataset description", "Dataset type", "Personal & sensitive data", "Dataset identifier & dates",
    "Storage place (host)", "Data access", "Licence", "Other distribution details", "Metadata & standards",
    "Contributors", "Project & funding",
]
# The coarser grouping, on paths without indices.
GROUP_RULES = [
    ("=dmp.dataset.title", "Dataset title"), ("=dmp.dataset.description", "Dataset description"),
    ("dmp.dataset.distribution", "Storage, access & licence"), ("dmp.dataset.metadata", "Metadata"),
    ("dmp.dataset.", "Dataset properties"), ("dmp.contact", "Contact"), ("dmp.contributor", "Contributors"),
    ("dmp.project", "Project & funding"),
]
GROUP_OTHER = "Plan information"


def _by_prefix(path: Column, rules: Sequence[tuple], pick: int, other: str) -> Column:
    """The *pick* of the first rule that *path* meets. The path is a pattern replaced in a text: bound to a name, it
    is computed once, not once per rule."""
    def chosen(bare: Column) -> Column:
        out = None
        for rule in rules:
            prefix = rule[0]
            hit = bare == prefix[1:] if prefix.startswith("=") else bare.startswith(prefix)
            out = F.when(hit, rule[pick]) if out is None else out.when(hit, rule[pick])
        return out.otherwise(other)

    return F.get(F.transform(F.array(path), chosen), F.lit(0))


def _in_form(path: Column) -> Column:
    return F.regexp_replace(bare_path(path), r"^dmp\.", "")


def form_section(path: Column) -> Column:
    """Section of the form."""
    return _by_prefix(_in_form(path), FORM_RULES, 1, FORM_OTHER[0])


def form_row(path: Column) -> Column:
    """Row of the form."""
    return _by_prefix(_in_form(path), FORM_RULES, 2, FORM_OTHER[1])


def form_group(path: Column) -> Column:
    """One of nine groups."""
    return _by_prefix(bare_path(path), GROUP_RULES, 1, GROUP_OTHER)


def top_part(path: Column) -> Column:
    """The key below the record's root."""
    parts = F.split(path, r"\.")
    return F.when((parts[0] == "dmp") & (F.size(parts) > 1), bare_path(F.get(parts, F.lit(1)))).otherwise(parts[0])


def form_order(row: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in FORM_ROWS]), row).cast("long")


Keys = str | Sequence[str]


def _names(by: Keys) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _by_field(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, field, _each, n, correct, mismatch, missed)``, the outcomes of each field by *by* (``_each`` 0), and over all
    of them the documents that have it as ``n`` (``_each`` above 0, *by* null). A place of the form is a matter of the
    field: what is left to be placed and summed up is a row per field, and the outcomes are read once for both."""
    counts = [_n("outcome", o).alias(o.lower()) for o in OUTCOMES]
    each = F.grouping_id().alias("_each")
    # A struct is never null, so a document without identifier is one as well.
    marked = outcomes.withColumn("_any", F.lit(True))  # told apart from the fields over all also where *by* is empty
    return marked.groupingSets([[*by, "_any", "field"], ["field"]], *by, "_any", "field").agg(each, F.count_distinct(F.struct("doc_id")).alias("n"), *counts)


def _fields_of(place: str, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of `_by_field` summed up by *place*, the fields of all documents beside each: ``(by, place, _all, counts)``."""
    over = F.sum(F.when(F.col("_each") > 0, F.col("n")))
    sums = found.groupBy(*by, "_each", place).agg(F.sum("n").alias("n"), *[F.sum(o.lower()).alias(o.lower()) for o in OUTCOMES])
    return sums.withColumn("_all", over.over(Window.partitionBy(place))).where("_each = 0").drop("_each", "n")


def field_matrix(outcomes: DataFrame, by: Keys = "model") -> DataFrame:
    """Count and share of the row by run and outcome, with a Total row; rows in form order.

    A field of several documents counts once per document.
    """
    by = _names(by)
    # Each field stands in its row and in the total.
    rows = F.explode(F.array(form_row(F.col("field")), F.lit("Total")))
    out = _fields_of("row", _by_field(outcomes, by).withColumn("row", rows), by).withColumnRenamed("_all", "n_row")
    order = F.when(F.col("row") == "Total", len(FORM_ROWS) + 1).otherwise(form_order(F.col("row")))
    shares = [_ratio(F.col(o.lower()), F.col("n_row")).alias(f"{o.lower()}_share") for o in OUTCOMES]
    return out.select(*by, order.cast("long").alias("row_order"), "row", "n_row", *[o.lower() for o in OUTCOMES], *shares)


def score_table(judged: DataFrame, by: Keys = "model") -> DataFrame:
    """Per document and pooled scores (``doc_id`` null): counts are pooled, then scored. A
    reference field counts as found once per document however many rows hit it. The outcomes of
    the annotated fields (J15) are counted beside the verdicts."""
    by = _names(by)
    hit = (F.col("verdict") == "Correct") & F.col("reference_value").isNotNull()
    annotated = ~is_empty_value(F.col("reference_value"))
    wrote_other = (F.col("verdict") == "Hallucinated") & (F.col("reason") != "empty where the reference has a value")
    per_field = judged.groupBy(*by, "doc_id", "field").agg(
        *[_n("verdict", v).alias(v.lower()) for v in VERDICTS], F.bool_or(hit).alias("_hit"), F.bool_or(annotated).alias("_annotated"),
        F.coalesce(F.bool_or(annotated & (F.col("verdict") == "Correct")), F.lit(False)).alias("_right"),
        F.coalesce(F.bool_or(annotated & wrote_other), F.lit(False)).alias("_other"),
    )
    kind = F.when(F.col("_right"), "Correct").when(F.col("_other"), "Mismatch").otherwise("Missed")
    per_doc = per_field.groupBy(*by, "doc_id").agg(
        *[F.sum(v.lower()).alias(v.lower()) for v in VERDICTS], F.count_if("_hit").alias("found"), F.count_if("_annotated").alias("annotated"),
        *[F.count_if(F.col("_annotated") & (kind == o)).alias(f"fields_{o.lower()}") for o in OUTCOMES],
    )
    counts = [c for c in per_doc.columns if c not in (*by, "doc_id")]
    # Both levels in one pass: a union of them would judge all records twice.
    sums = per_doc.groupingSets([[*by, "doc_id"], by], *by, "doc_id").agg(*[F.sum(c).alias(c) for c in counts]).withColumn("n_ref", F.col("found") + F.col("missed"))
    return _with_scores(sums, F.col("found"))


def f1_range(scores: DataFrame, by: Keys = "model") -> DataFrame:
    """Spread of per-document F1 by model."""
    return scores.where(F.col("doc_id").isNotNull()).groupBy(*_names(by)).agg(F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"))


def best_run(scores: DataFrame, by: str = "model", within: Sequence[str] = ()) -> DataFrame:
    """The pooled row with the highest F1, of each *within*; by name on ties."""
    pooled = scores.where(F.col("doc_id").isNull())
    return pooled.groupBy(*within).agg(F.min(F.struct((-F.col("f1")).alias("neg"), F.col(by))).alias("b")).select(
        *within, F.col(f"b.{by}").alias("best"), (-F.col("b.neg")).alias("f1")
    )


def verdict_shares(judged: DataFrame, by: str = "model") -> DataFrame:
    """J20"""
    names = [v.lower() for v in VERDICTS]
    counts = judged.groupBy(by).agg(*[_n("verdict", v).alias(v.lower()) for v in VERDICTS], F.count("*").alias("n_judged"))
    return counts.select(by, *names, "n_judged", *[_ratio(F.col(n), F.col("n_judged")).alias(f"{n}_share") for n in names])


def missed_by_section(judged: DataFrame, ref_leaves: DataFrame, models: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Reference fields per top-level part, and how many each model missed, of each *within*. A section
    nothing was missed in stands in each of them too, as long as it was judged there.

    The rows judged are read once; they and the leaves are counted by path before paths are placed."""
    paths = ref_leaves.where(~is_empty_value(F.col("value"))).groupBy("path").agg(F.count("*").alias("n"))
    fields = paths.groupBy(top_part(F.col("path")).alias("section")).agg(F.sum("n").alias("n_reference"))
    missed = [F.count_if((F.col("verdict") == "Missed") & (F.col("model") == m)).alias(m) for m in models]
    found = judged.groupBy(*within, "field").agg(F.count_if(~is_empty_value(F.col("reference_value"))).alias("_judged"), F.count_if(F.col("verdict") == "Missed").alias("_missed"), *missed)
    gone = found.groupBy(*within, top_part(F.col("field")).alias("section")).agg(*[F.sum(c).alias(c) for c in ("_judged", "_missed", *models)])
    gone = gone.where("_judged > 0" if within else "_missed > 0")
    return fields.join(gone, on="section", how="inner" if within else "left").select(
        *within, "section", "n_reference", *[F.coalesce(m, F.lit(0)).alias(m) for m in models]
    )


def natural_order(path: Column) -> Column:
    """A sort key that puts [2] before [10]."""
    return F.regexp_replace(F.regexp_replace(path, r"(\d+)", "000000000$1"), r"0*(\d{10})", "$1")


def field_wide(outcomes: DataFrame, judged: DataFrame, models: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """A row per annotated field of each *within*: the reference value (60 characters), each
    model's outcome and, for a mismatch, what it wrote (45 characters)."""
    key = [*within, "doc_id", "field"]
    text = F.lit(None).cast("string")
    wrote = F.when(F.col("verdict") == "Hallucinated", F.col("model_value"))
    value = F.when(~is_empty_value(F.col("reference_value")), F.col("reference_value"))
    # Both tables have a row per field and model, so they are stacked and grouped once, not joined.
    stacked = outcomes.select(*key, "model", "outcome", text.alias("_wrote"), text.alias("_value")).unionByName(
        judged.select(*key, "model", text.alias("outcome"), wrote.alias("_wrote"), value.alias("_value"))
    )
    cells, shown = [], []
    for i, m in enumerate(models):
        mine = F.col("model") == m
        cells += [F.max(F.when(mine, F.col("outcome"))).alias(f"{m}_outcome"), F.min(F.when(mine, F.col("_wrote"))).alias(f"_wrote{i}")]
        cells.append(F.bool_or(mine & (F.col("outcome") == "Mismatch")).alias(f"_other{i}"))
        shown += [f"{m}_outcome", F.when(F.col(f"_other{i}"), F.coalesce(F.substring(f"_wrote{i}", 1, 45), F.lit(""))).otherwise("").alias(f"{m}_wrote")]
    grouped = stacked.groupBy(*key).agg(*cells, F.min("_value").alias("_value"), F.count("outcome").alias("_outcomes"))
    wide = grouped.where("_outcomes > 0 AND _value IS NOT NULL").select(*key, *shown, F.substring("_value", 1, 60).alias("annotated_value"))
    return wide.withColumn("sort_key", natural_order(F.col("field")))


def group_correct(outcomes: DataFrame, by: Keys = "model") -> DataFrame:
    """Correct and annotated fields per model and group."""
    by = _names(by)
    out = _fields_of("grp", _by_field(outcomes, by).withColumn("grp", form_group(F.col("field"))), by)
    return out.select("grp", *by, "correct", F.col("_all").alias("n_fields")).withColumn("share", _ratio(F.col("correct"), F.col("n_fields")))


def version_compare(outcomes: DataFrame, judged: DataFrame) -> DataFrame:
    """Outcomes per version and model and per version (``model`` null), with the fields
    written that the reference does not have."""
    names = [o.lower() for o in OUTCOMES]
    counted = outcomes.groupBy("run", "model").agg(*[_n("outcome", o).alias(o.lower()) for o in OUTCOMES])
    extra = judged.groupBy("run", "model").agg(
        F.count_if(F.col("verdict") != "Missed").alias("written"), F.count_if(F.col("reason") == "not in the reference").alias("not_in_reference")
    )
    return counted.join(extra, on=["run", "model"]).rollup("run", "model").agg(
        *[F.sum(n).alias(n) for n in [*names, "written", "not_in_reference"]]
    ).where(F.col("run").isNotNull())


def version_by_part(outcomes: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Correct / mismatch / missed per part of the form, a column per version."""
    # Outcomes are counted by field before the few fields left are placed in the form.
    of_field = outcomes.groupBy("run", "field").agg(*[_n("outcome", o).alias(o) for o in OUTCOMES])
    counted = of_field.groupBy("run", form_row(F.col("field")).alias("row")).agg(*[F.sum(o).alias(o) for o in OUTCOMES])
    cell = F.concat_ws(" / ", *[F.col(o).cast("string") for o in OUTCOMES])
    counted = counted.select("run", "row", cell.alias("cell"))
    return counted.groupBy("row").agg(
        *[F.coalesce(F.max(F.when(F.col("run") == r, F.col("cell"))), F.lit("0 / 0 / 0")).alias(r) for r in runs]
    ).withColumn("row_order", form_order(F.col("row")))


def samples_summary(outcomes: DataFrame) -> DataFrame:
    """J26"""
    return outcomes.groupBy("run", "model", "doc_id").agg(_n("outcome", "Correct").alias("correct"), F.count("*").alias("n_fields"))


def by_requirement(outcomes: DataFrame, markers: DataFrame, by: str = "model") -> DataFrame:
    """Correct and annotated fields, split by what the form says of the field. *markers*
    holds one row per field of the form."""
    marked = outcomes.withColumn("form_field", bare_path(F.col("field"))).join(
        markers.select(F.col("field").alias("form_field"), "marker"), on="form_field", how="left"
    )
    return marked.groupBy(by, F.coalesce("marker", F.lit("not in form")).alias("marker")).agg(
        _n("outcome", "Correct").alias("correct"), F.count("*").alias("n_fields")
    )


def run_timings(runs: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per timed call of a run file, tokens sent also rounded to hundreds."""
    entry = "map<string, struct<seconds: double, model_load_seconds: double, tokens_sent: bigint, tokens_generated: bigint>>"
    parsed = runs.select("run", F.from_json(raw, f"struct<timings: {entry}>").alias("r"))
    return parsed.select("run", F.explode("r.timings").alias("call", "t")).select(
        "run", "call", "t.seconds", "t.model_load_seconds", "t.tokens_sent", "t.tokens_generated",
        F.bround("t.tokens_sent", -2).alias("tokens_rounded"),
    )


# The form. Per object (path without indices): what it must hold, what it may hold.
FORM_OBJECTS = {
    "": (["dmp"], []),
    "dmp": (["title", "created", "modified", "language", "ethical_issues_exist", "dmp_id", "contact", "dataset"], ["description", "project"]),
    "dmp.dmp_id": (["identifier", "type"], []),
    "dmp.contact": (["name", "mbox", "contact_id"], []),
    "dmp.contact.contact_id": (["identifier", "type"], []),
    "dmp.dataset": (["title", "description", "type", "personal_data", "sensitive_data", "dataset_id", "distribution", "metadata"], []),
    "dmp.dataset.dataset_id": (["identifier", "type"], []),
    "dmp.dataset.distribution": (["title", "data_access", "license"], ["host"]),
    "dmp.dataset.distribution.host": (["title"], ["url"]),
    "dmp.dataset.distribution.license": (["license_ref", "start_date"], []),
    "dmp.dataset.metadata": (["description", "language", "metadata_standard_id"], []),
    "dmp.dataset.metadata.metadata_standard_id": (["identifier", "type"], []),
    "dmp.project": (["title", "description"], ["funding"]),
    "dmp.project.funding": (["funder_id", "funding_status"], []),
    "dmp.project.funding.funder_id": (["identifier", "type"], []),
}
# Paths that hold lists, those of them that need an item, and the choices of a field.
FORM_LISTS = [
    "dmp.contact.contact_id", "dmp.dataset", "dmp.dataset.distribution", "dmp.dataset.distribution.license", "dmp.dataset.metadata",
    "dmp.dataset.metadata.metadata_standard_id", "dmp.project", "dmp.project.funding",
]
NOT_EMPTY = ["dmp.dataset", "dmp.dataset.distribution", "dmp.dataset.metadata"]
CHOICES = {
    "dmp.ethical_issues_exist": ["yes", "no", "unknown"], "dmp.dataset.personal_data": ["yes", "no", "unknown"],
    "dmp.dataset.sensitive_data": ["yes", "no", "unknown"], "dmp.dataset.distribution.data_access": ["open", "shared", "closed"],
    "dmp.project.funding.funding_status": ["planned", "applied", "granted", "rejected"],
}


def conformance(found: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """What is wrong with each record: ``(keys, path, problem)`` with the problems ``missing``
    (a field or container that its object owes), ``extra`` (a member the form lacks, named once),
    ``empty list``, ``wrong kind`` (a text, an object or a list in place of another of them) and
    ``not allowed value``.

    *found* holds `record_nodes` rows. What an object owes and may hold is known from its own row,
    so nothing is joined; the rules above are constants inside the plan.
    """
    form = bare_path(F.col("path"))
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    table = lambda pairs: F.create_map(*[c for k, v in pairs for c in (F.lit(k), v)])
    owes = F.try_element_at(table([(k, texts(must)) for k, (must, _) in FORM_OBJECTS.items()]), F.col("form"))
    holds = F.try_element_at(table([(k, texts(must + may)) for k, (must, may) in FORM_OBJECTS.items()]), F.col("form"))
    choices = F.try_element_at(table([(k, texts(v)) for k, v in CHOICES.items()]), F.col("form"))
    # A list and its items share a path without indices; the path itself ends in an index for items.
    is_item = F.col("path").endswith("]")
    due = (
        F.when(F.col("form").isin(FORM_LISTS) & ~is_item, "list").when(F.col("form").isin(list(FORM_OBJECTS)), "object")
        .when(F.col("form").isin([f"{k}.{c}" for k, (must, may) in FORM_OBJECTS.items() if k for c in must + may]) & ~is_item, "leaf")
    )
    child = lambda name: F.when(F.col("path") == "", name).otherwise(F.concat("path", F.lit("."), name))
    problem = lambda path, what: F.struct(path.alias("path"), F.lit(what).alias("problem"))
    none = F.array().cast("array<struct<path:string,problem:string>>")
    wrong_kind = F.col("due").isNotNull() & (F.col("kind") != F.col("due"))
    is_form_object = (F.col("kind") == "object") & (F.col("due") == "object")
    found = found.withColumn("form", form).withColumn("due", due)
    rows = F.concat(
        F.when(is_form_object, F.transform(F.array_except(owes, F.col("names")), lambda n: problem(child(n), "missing"))).otherwise(none),
        F.when(is_form_object, F.transform(F.array_except(F.col("names"), holds), lambda n: problem(child(n), "extra"))).otherwise(none),
        F.when(wrong_kind, F.array(problem(F.col("path"), "wrong kind"))).otherwise(none),
        F.when((F.col("kind") == "list") & (F.col("size") == 0) & F.col("form").isin(NOT_EMPTY) & ~is_item, F.array(problem(F.col("path"), "empty list"))).otherwise(none),
        F.when((F.col("kind") == "leaf") & choices.isNotNull() & ~F.coalesce(F.array_contains(choices, F.col("value")), F.lit(False)), F.array(problem(F.col("path"), "not allowed value"))).otherwise(none),
    )
    return found.select(*keys, F.inline(rows))


def judged_listing(judged: DataFrame) -> DataFrame:
    """Written fields per run, wrong ones first, in document and path order.

    Rows are dealt by ranges of records; what a record's rows are sorted by is made behind that, once per row: as an
    expression of the sort it would be computed anew at every comparison."""
    shown = judged.where(F.col("verdict") != "Missed").select(*RECORD, F.col("model_field").alias("field"), "model_value", "reference_value", "verdict", "reason")
    order = {"_rank": F.when(F.col("verdict") == "Hallucinated", 0).otherwise(1), "_path": natural_order(F.col("field"))}
    return shown.repartitionByRange(*RECORD).withColumns(order).sortWithinPartitions(*RECORD, *order).drop(*order)


def verdict_counts(judged: DataFrame, keys: Sequence[str] = ("run", "model")) -> DataFrame:
    """The counts printed above the listing."""
    return judged.groupBy(*keys).agg(*[_n("verdict", v).alias(v.lower()) for v in VERDICTS])
