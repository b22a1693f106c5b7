"""Labeled blocks: parsing model answers, cleaning, grouping, comparing runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.functions.json_text import last_values
from docstruct.functions.text import collapse, is_blank, strip
from docstruct.labels import ANSWER, LABELS
from docstruct.operators.ordered import chunks_for, scan

KEYS = ("tag", "doc_id")


def parse_blocks_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """B1: add ``blocks`` (array of text, label) and ``reason`` (null when usable) from *raw*.

    Takes a list, or the first value of an object that is a list, with or without a code fence; a
    repeated key counts with its last value. An
    absent label becomes ``answer.text``; a null one stays null. Entries that are no objects are
    left out and their positions listed in ``bad_entries``; the others keep their order.
    """
    text = strip(F.col(raw))
    fenced = F.regexp_extract(text, r"(?s)^```(.*?)(?:```|$)", 1)
    body = F.when(text.startswith("```"), strip(F.regexp_replace(fenced, r"^json", ""))).otherwise(text)
    df = df.withColumn("_body", last_values(body)).withColumn("_value", F.try_parse_json("_body"))
    members = F.try_variant_get("_value", "$", "map<string,variant>")
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    df = df.withColumns({"_members": members, "_own": listed(F.col("_value"))})
    lists = F.filter(F.transform(F.json_object_keys("_body"), lambda k: listed(F.col("_members")[k])), lambda x: x.isNotNull())
    df = df.withColumn("_list", F.coalesce("_own", F.get(lists, F.lit(0))))
    entry = "map<string,variant>"
    objects = F.transform("_list", lambda v, i: F.struct(F.try_variant_get(v, "$", entry).alias("m"), i.cast("int").alias("i")))
    df = df.withColumn("_objects", objects)
    word = lambda v: F.try_variant_get(v, "$", "string")
    blocks = F.transform(
        F.filter("_objects", lambda o: o["m"].isNotNull()),
        lambda o: F.struct(
            F.coalesce(word(o["m"]["text"]), F.lit("")).alias("text"),
            F.when(F.map_contains_key(o["m"], F.lit("label")), word(o["m"]["label"])).otherwise(ANSWER).alias("label"),
        ),
    )
    reason = (
        F.when(is_blank(F.col(raw)), "empty response")
        .when(F.col("_value").isNull(), "not valid JSON")
        .when(F.col("_list").isNull(), "no list in the response")
    )
    bad = F.transform(F.filter("_objects", lambda o: o["m"].isNull()), lambda o: o["i"])
    usable = F.col("reason").isNull()
    return df.withColumn("reason", reason).withColumns({
        "blocks": F.when(usable, blocks).otherwise(F.array()), "bad_entries": F.when(usable, bad).otherwise(F.array().cast("array<int>")),
    }).drop("_body", "_value", "_members", "_own", "_list", "_objects")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """B2: collapse white space, drop blank texts; labels are not checked."""
    return blocks.withColumn("text", collapse(F.coalesce("text", F.lit("")))).where("text <> ''")


def dropped_blocks(blocks: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """How many blank blocks cleaning drops, by label."""
    return blocks.where(is_blank(F.col("text"))).groupBy(*keys, "label").agg(F.count("*").alias("n"))


def label_counts(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Blocks per label, per *keys*. The five labels are fixed, so no pivot pass is needed."""
    return blocks.groupBy(*keys).agg(
        *[F.count_if(F.col("label") == x).alias(x.replace(".", "_")) for x in LABELS], F.count("*").alias("n_blocks")
    )


def page_count(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct pages per document; null pages do not count."""
    return blocks.groupBy(*keys).agg(F.count_distinct("page").alias("n_pages"))


def _numbered_runs(blocks: DataFrame, keys: Sequence[str], chunks: int | str | None) -> DataFrame:
    if chunks == "auto":
        chunks = chunks_for(blocks, keys)
    if chunks is not None:
        # Identifiers and labels are scanned in chunks, the rest is joined back once.
        slim = _run_numbers(blocks.select(*keys, "pos", "label"), keys, chunks).drop("label")
        return blocks.join(slim, [*keys, "pos"])
    return _run_numbers(blocks, keys, None)


def _run_numbers(blocks: DataFrame, keys: Sequence[str], chunks: int | None) -> DataFrame:
    before = scan(
        blocks, keys, "pos", chunks=chunks, lags={"_prev": F.struct(F.col("label").alias("label"))}
    )
    new = F.col("_prev").isNull() | ~F.col("_prev.label").eqNullSafe(F.col("label"))
    return scan(before.withColumn("_new", new.cast("int")), keys, "pos", chunks=chunks, sums={"run_no": F.col("_new")})


def join_runs(blocks: DataFrame, keys: Sequence[str] = KEYS, chunks: int | str | None = "auto") -> DataFrame:
    """Neighbouring blocks with one label become one item; its confidence is the lowest."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"])
    return _numbered_runs(blocks, keys, chunks).groupBy(*keys, "run_no").agg(
        F.min("pos").alias("pos"), F.first("label").alias("label"), F.array_join(parts, " ").alias("text"),
        F.min("confidence").alias("confidence"), F.count("*").alias("n_blocks"),
    ).drop("run_no")


def label_runs(blocks: DataFrame, keys: Sequence[str] = KEYS, chunks: int | str | None = "auto") -> DataFrame:
    """Blocks, label runs (1 + changes) and runs per block of each document.

    A document without blocks has no row here; joining the document list and filling 1 gives
    the count the definition asks for.
    """
    return _numbered_runs(blocks, keys, chunks).groupBy(*keys).agg(
        F.count("*").alias("n_blocks"), F.sum("_new").alias("n_runs")
    ).withColumn("runs_per_block", F.col("n_runs") / F.col("n_blocks"))


def label_disagreements(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Positions at which two runs label a block differently."""
    left = a.select(key, "pos", "text", F.col("label").alias("label_a"))
    right = b.select(key, "pos", F.col("label").alias("label_b"))
    return left.join(right, on=[key, "pos"]).where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def disagreement_window(
    a: DataFrame, b: DataFrame, key: str = "doc_id", before: int = 5, rows: int = 12,
    chunks: int | str | None = "auto",
) -> DataFrame:
    """The stretch of *rows* blocks that starts *before* blocks ahead of each document's
    middle disagreement."""
    diff = label_disagreements(a, b, key)
    if chunks == "auto":
        chunks = chunks_for(diff, [key])
    counted = scan(diff, [key], "pos", chunks=chunks, sums={"nth": F.lit(1)})
    total = diff.groupBy(key).agg(F.floor(F.count("*") / 2).alias("half"))
    start = counted.join(total, on=key).where(F.col("nth") == F.col("half") + 1).select(
        key, F.greatest(F.lit(0), F.col("pos") - before).alias("start")
    )
    left = a.select(key, "pos", "text", F.col("label").alias("label_a"))
    right = b.select(key, "pos", F.col("label").alias("label_b"))
    in_window = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + rows)
    return left.join(start, on=key).where(in_window).join(right, on=[key, "pos"], how="left").drop("start")


def labels_wide(blocks: DataFrame, tags: Sequence[str], key: str = "doc_id") -> DataFrame:
    """One row per block, one label column per run in *tags*."""
    return blocks.groupBy(key, "pos").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("label"))).alias(t) for t in tags]
    )


def label_blocks(df: DataFrame, labeler: Callable[[Sequence[str]], Sequence[str]], text: str = "text") -> DataFrame:
    """Hook for a user's labeler, called with one Arrow batch of texts at a time."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "label")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.drop(columns="label", errors="ignore").assign(label=list(labeler(batch[text].tolist())))

    return df.mapInPandas(run, schema=f"{columns}, label string")


def split_prompt(template: str) -> tuple[str, str]:
    """(system part, user part) of a prompt file, which needs a ``{dmp_text}`` place."""
    body = template.removeprefix("SYSTEM:\n")
    parts = re.split(r"(?m)^PROMPT(?: \([^)\n]*\))?:[ \t]*$", body, maxsplit=1)
    if len(parts) != 2:
        raise ValueError("the prompt file has no PROMPT: line")
    system, user = parts[0].rstrip("\n") + "\n", parts[1].strip("\n")
    if "{dmp_text}" not in user:
        raise ValueError("the user prompt has no {dmp_text} place")
    return system, user


def render_prompts(docs: DataFrame, template: str, schema_text: str, today: str, text: str = "text") -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt`` to every document."""
    system, user = split_prompt(template)
    system = system.replace("<<TODAY>>", today)
    user = user.replace("{schema_text}", schema_text)
    return docs.withColumns(
        {"system_prompt": F.lit(system), "user_prompt": F.replace(F.lit(user), F.lit("{dmp_text}"), F.col(text))}
    )


def with_default_label(label: Column, present: Column) -> Column:
    """The label a reader hands on: ``answer.text`` only where the key itself is absent."""
    return F.when(present, label).otherwise(F.lit(ANSWER))
