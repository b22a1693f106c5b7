"""Near duplicates among embedding vectors by cross-polytope hashing.

A hash function turns a vector by three rounds of random signs and a fast Hadamard transform and
takes the nearest of the 2d signed axes; a table combines several functions. Each vector is filed
in its own bucket and in the next likeliest ones (multiprobe) of every table, and vectors that
share a bucket are compared by cosine in double precision.

Equal vectors are one class before anything is compared. Buckets of few classes give pairs.
Larger ones are cut into blocks of bounded size; a task compares two blocks as matrices and returns
per vector how many links it has and the smallest member of its part, never the pairs. A pair that
shares several large buckets is counted in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.components import components
from docstruct.llm.store import written

TABLES, FUNCTIONS, PROBES = 8, 3, 4
LARGE, BLOCK = 64, 2048


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, large: int = LARGE, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """One row per row of *vectors*: id, n_links, component_id, kept.

    n_links counts the other rows whose cosine is *threshold* or more (of the pairs found; see the
    README for the measured recall), component_id is the smallest identifier reachable, kept tells
    whether it is the own one. Vectors that are null, empty, zero, or hold null or non-finite
    numbers link with nothing; vectors of different lengths do not link. Equal vectors link
    whatever their number. Rows that repeat an identifier count as rows of their own; a null
    identifier gets the smallest of its component, or null, and is kept only in the latter case.
    An empty table gives an empty result; further columns are ignored.

    With more vectors take more *functions*: buckets number (2 d) ** functions per table.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")

    filed = written(classes.select("c", "v").mapInArrow(_filed(tables, functions, probes, seed), "c bigint, unit array<double>, buckets array<bigint>"), "vector-buckets")
    index = filed.select("c", F.explode("buckets").alias("bucket"))
    counts = index.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    index = written(index.join(counts, "bucket"), "vector-index")
    in_large = index.where(F.col("n") > large).groupBy("c").agg(F.sort_array(F.collect_list("bucket")).alias("large"))
    cards = filed.drop("buckets").join(classes.select("c", "m"), "c").join(in_large, "c", "left")
    cards = written(cards.withColumn("large", F.coalesce("large", F.array().cast("array<bigint>"))), "vector-cards")

    small = index.where(F.col("n") <= large)
    pairs = small.select("bucket", F.col("c").alias("a")).join(small.select("bucket", F.col("c").alias("b")), "bucket").where("a < b").select("a", "b").distinct()
    side = lambda s: cards.select(*[F.col(x).alias(y) for x, y in (("c", s), ("unit", f"u_{s}"), ("m", f"m_{s}"), ("large", f"l_{s}"))])
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(~F.arrays_overlap("l_a", "l_b"))
    pairs = pairs.select("a", "b", "m_a", "m_b", "u_a", "u_b").mapInArrow(_near(threshold), "a bigint, b bigint, m_a bigint, m_b bigint")
    pairs = written(pairs, "vector-pairs")

    # Block number of a class in its bucket, and one row per block it is compared with.
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = index.where(F.col("n") > large).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("c"), blocks).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("c", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(cards, "c")
    schema = "c bigint, links bigint, low bigint"
    inside = dealt.groupBy("bucket", "i", "j").applyInArrow(_block(threshold), schema)
    inside = written(inside, "vector-blocks")

    links = pairs.select(F.col("a").alias("c"), F.col("m_b").alias("links")).union(pairs.select("b", "m_a")).union(inside.select("c", "links"))
    links = links.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(pairs.select("a", "b").union(inside.select("c", "low")))
    parts = classes.join(roots, F.col("c") == F.col("node"), "left").select("c", "v", "rep", "m", F.coalesce("root", "c").alias("root"))
    lowest = parts.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = parts.join(lowest, "root").join(links, "c", "left").select(
        "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = rows.join(classes, "v", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate(([0], lengths)))
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def buckets(unit: np.ndarray, tables: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """Keys of the own bucket and the *probes* likeliest others, per table and row."""
    n, length = unit.shape
    d = 1 << max(1, (length - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :length] = unit
    rng = np.random.default_rng([seed, length])
    near = min(3, d)
    choice = np.stack(np.meshgrid(*[range(near)] * functions, indexing="ij"), -1).reshape(-1, functions)
    keys = []
    for table in range(tables):
        cost, key = 0.0, np.full((n, len(choice)), hash((length, table)) & 0xFFFF, np.uint64)
        for number in range(functions):
            y = x
            for signs in rng.choice([-1.0, 1.0], size=(3, d)):
                y = hadamard(y * signs)
            size = np.abs(y)
            best = np.argsort(-size, 1, kind="stable")[:, :near]
            top = np.take_along_axis(size, best, 1)
            axis = (2 * best + (np.take_along_axis(y, best, 1) < 0)).astype(np.uint64)
            pick = choice[:, number]
            cost = cost + ((top[:, :1] - top) ** 2)[:, pick]
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (axis[:, pick] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(cost, 1, kind="stable")[:, : probes + 1]
        keys.append(np.take_along_axis(key, order, 1))
    return np.concatenate(keys, 1).view(np.int64)


def _filed(tables: int, functions: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                for at, x in _rows(part.column("v")):
                    x = x / np.abs(x).max(1)[:, None]
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    keys = buckets(x, tables, functions, probes, seed)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1))) for m in (x, keys)]
                    yield pa.RecordBatch.from_arrays([part.column("c").take(pa.array(at)), *lists], ["c", "unit", "buckets"])

    return run


def _near(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for (at, x), (_, y) in zip(_rows(batch.column("u_a")), _rows(batch.column("u_b"))):
                good[at] = (x * y).sum(1) >= threshold
            yield batch.select(["a", "b", "m_a", "m_b"]).filter(pa.array(good))

    return run


def _block(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("c")
        bucket, i, j = (k.as_py() for k in key)
        c, m, own = (rows.column(x).to_numpy() for x in ("c", "m", "own"))
        x = rows.column("unit").combine_chunks()
        x = x.flatten().to_numpy().reshape(len(c), -1)
        linked = np.zeros((len(c), len(c)), bool)
        for start in range(0, len(c), 512):
            linked[start : start + 512] = x[start : start + 512] @ x.T >= threshold
        linked |= linked.T
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= own[:, None] != own[None, :]
        counted = linked & ~_met_before(rows.column("large").to_pylist(), bucket)
        low = np.arange(len(c))
        while True:
            least = np.where(linked, low[None, :], len(c)).min(1, initial=len(c))
            after = np.minimum(low, least)
            after = np.minimum(after, after[after])
            if (after == low).all():
                break
            low = after
        return pa.table({"c": c, "links": counted @ m, "low": c[low]})

    return run


def _met_before(large: list[list[int]], bucket: int) -> np.ndarray:
    """Pairs of rows that share a large bucket with a smaller key."""
    at: dict[int, list[int]] = {}
    for row, keys in enumerate(large):
        for key in keys:
            if key < bucket:
                at.setdefault(key, []).append(row)
    met = np.zeros((len(large), len(large)), bool)
    for rows in {tuple(r) for r in at.values() if len(r) > 1}:
        met[np.ix_(rows, rows)] = True
    return met
