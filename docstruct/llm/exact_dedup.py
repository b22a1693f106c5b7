"""Exact duplicates by sorting the contents.

Splitters sampled over (first characters, digest, identifier) range-partition the rows, Spark's
external sort places equal texts next to each other, and one pass over each sorted partition
compares every text with its neighbour in full. The identifier is part of the splitters, so a
group of copies of any size is spread over partitions; the runs that touch a partition's ends are
put together afterwards, by their full text, from one row per end.

Splitters hold a short prefix and the digest rather than the text, so that the sample that
reaches the driver does not grow with the length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.store import written

PREFIX_CHARS = 16


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "smallest",
) -> DataFrame:
    """One row per row of *docs*: id, keep_id, group_size, kept, text_sha256.

    *text* is the normalised text to compare (default: column ``text`` unchanged); *keep* is
    ``smallest`` or ``largest`` identifier. A null text counts as empty, and empty texts are equal.
    A null identifier sorts below all others. Of rows that repeat one identifier and text only one
    is kept. An empty table gives an empty result; further columns of *docs* are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    source = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("norm"),
    ).withColumns({"sha": F.sha2(F.col("norm").cast("binary"), 256), "pre": F.substring("norm", 1, PREFIX_CHARS)})
    # The row that stays comes last in its run.
    order = F.asc_nulls_first("id") if keep == "largest" else F.desc_nulls_last("id")
    ranged = source.repartitionByRange("pre", "sha", order).sortWithinPartitions("pre", "sha", "norm", order)
    marked = ranged.select(F.spark_partition_id().alias("part"), "id", "sha", "norm").mapInArrow(
        _runs, "is_run boolean, part int, run bigint, k bigint, id bigint, sha string, edge string"
    )
    # Fixed on disk: partition and run numbers must not change between the two readers below.
    marked = written(marked, "exact-runs")
    runs = marked.where("is_run").select("part", "run", F.col("k").alias("n"), F.col("id").alias("last"), "edge")
    ends = runs.where("edge IS NOT NULL")
    whole = ends.groupBy("edge").agg(
        F.sum("n").alias("all_n"), F.max("part").alias("all_part"), F.max_by(F.struct("last"), "part")["last"].alias("all_last")
    )
    whole = ends.join(whole, "edge").select("part", "run", "all_n", "all_part", "all_last")
    runs = runs.drop("edge").join(whole, ["part", "run"], "left").select(
        "part", "run", "n", F.coalesce("all_n", "n").alias("group_size"), F.coalesce("all_part", "part").alias("keep_part"),
        F.when(F.col("all_n").isNull(), F.col("last")).otherwise(F.col("all_last")).alias("keep_id"),
    )
    rows = marked.where("NOT is_run").select("part", "run", "k", "id", "sha")
    return rows.join(runs, ["part", "run"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        ((F.col("k") == F.col("n")) & (F.col("part") == F.col("keep_part"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts in a sorted partition. Per row: its run and place in it; per
    run: its length and last identifier, and for the first and last run the text."""
    run, length, last, text, part = -1, 0, None, None, None  # the open run
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm, ids = batch.column("norm"), batch.column("id")
        part = batch.column("part")[0].as_py()
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = norm[0].as_py() != text
        number = run + np.cumsum(new)
        starts = np.flatnonzero(new)
        begun = np.zeros(n, np.int64)  # where each row's run begins in this batch; the open one began before it
        begun[starts] = starts
        begun = np.maximum.accumulate(begun)
        k = np.arange(n) - begun + 1
        k[number == run] += length
        yield _out(False, [part] * n, number, k, ids, batch.column("sha"), pa.nulls(n, pa.string()))
        # Runs that end before the batch does: the open one, and all begun here but the last.
        ends = (starts if starts.size and (run >= 0 or starts[0] > 0) else starts[1:]) - 1
        if ends.size:
            closed = [run if e < 0 else int(number[e]) for e in ends]
            sizes = [length if e < 0 else int(k[e]) for e in ends]
            lasts = [last if e < 0 else ids[int(e)].as_py() for e in ends]
            edges = [(text if run == 0 else norm[0].as_py()) if r == 0 else None for r in closed]
            yield _out(True, [part] * len(closed), closed, sizes, pa.array(lasts, pa.int64()), pa.nulls(len(closed), pa.string()), pa.array(edges, pa.string()))
        run, length, last, text = int(number[-1]), int(k[-1]), ids[n - 1].as_py(), norm[n - 1].as_py()
    if run >= 0:
        yield _out(True, [part], [run], [length], pa.array([last], pa.int64()), pa.nulls(1, pa.string()), pa.array([text], pa.string()))


def _out(is_run, part, run, k, ids, sha, edge) -> pa.RecordBatch:
    n = len(part)
    columns = [pa.array([is_run] * n), pa.array(part, pa.int32()), pa.array(run, pa.int64()), pa.array(k, pa.int64()), ids, sha, edge]
    return pa.RecordBatch.from_arrays(columns, ["is_run", "part", "run", "k", "id", "sha", "edge"])
