"""From raw model answers to nested documents at both stages, for what still has to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.operators.blocks import clean_blocks, parse_blocks_json
from docstruct.operators.nest import nest
from docstruct.operators.ordered import chunks_for
from docstruct.operators.quality import choose_text
from docstruct.operators.rules import apply_rules
from docstruct.sources.io import pending, stale_runs, write_stage

KEYS = ("tag", "doc_id")


def to_ask(candidates: DataFrame, done: DataFrame, wanted: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Documents whose answer is still to be had, with their best readable text: those that *done*
    ``(doc_id)`` lacks, and those whose run record in *manifest* differs from the *wanted* one."""
    texts = choose_text(candidates)
    open_ = pending(texts.select("doc_id"), done, ["doc_id"])
    if wanted is not None and manifest is not None:
        open_ = open_.unionByName(stale_runs(wanted, manifest).select("doc_id")).distinct()
    return texts.join(open_, "doc_id", "left_semi")


def narratives(
    answers: DataFrame, done: DataFrame | None = None, out: str | None = None, keys: Sequence[str] = KEYS, chunks: int | str | None = "auto",
) -> dict[str, DataFrame]:
    """Raw answers ``(keys, raw)`` to ``blocks`` (stage 2), ``nested`` (stage 3 slots) and ``filled``
    (stage 4, rules applied); ``rejected`` holds answers without blocks, with the reason.

    Documents in *done* ``(keys)`` are left out. With *out* each stage is written to
    ``<out>/<stage>`` by tag and the next one starts from what was written; only the tags at hand are replaced.
    """
    fresh = answers if done is None else pending(answers, done, keys)
    parsed = parse_blocks_json(fresh)
    rejected = parsed.where("reason IS NOT NULL").select(*keys, "raw", "reason")
    rows = parsed.where("reason IS NULL").select(*keys, F.posexplode("blocks").alias("pos", "b")).select(*keys, "pos", "b.text", "b.label")
    tables = {"rejected": rejected}

    def stage(name: str, made: DataFrame) -> DataFrame:
        if out is not None:
            write_stage(made, f"{out}/{name}")
            tags = made.select("tag").distinct()
            made = made.sparkSession.read.schema(made.schema).parquet(f"{out}/{name}").join(tags, "tag", "left_semi").select(*made.columns)
        tables[name] = made
        return made

    blocks = stage("blocks", clean_blocks(rows))
    if chunks == "auto":
        chunks = chunks_for(blocks, keys)
    nested = stage("nested", nest(blocks, keys, chunks))
    stage("filled", apply_rules(nested, keys, long_docs=chunks is not None))
    return tables
