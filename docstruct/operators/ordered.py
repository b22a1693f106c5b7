"""Running values along an ordered group, also where one group holds a large share of all rows.

A plain window puts a whole group in one task. Where a group is too long for that, the rows are
range-partitioned on (keys, order) into chunks, each chunk of a group is reduced to one summary
row, the few summary rows are scanned, and every chunk starts from the value carried in. Both
ways give the same result; `chunks_for` decides which is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.session import cut_lineage

CHUNK_ROWS = 1_000_000

Named = dict[str, Column]


def chunks_for(df: DataFrame, keys: Sequence[str], limit: int = CHUNK_ROWS) -> int | None:
    """How many chunks of *limit* rows to cut *df* into when some group of *keys* is longer than
    that, else None (plain windows do).

    Costs one aggregate over the key columns; a single row of two numbers reaches the driver.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    longest, total = sizes[0] or 0, sizes[1] or 0
    return None if longest <= limit else -(-total // limit)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    *,
    sums: Named | None = None,
    mins: Named | None = None,
    lasts: Named | None = None,
    lags: Named | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Add running columns over *keys*, ordered by *order*, which is unique within the keys.

    sums, mins: inclusive running sum and minimum
    lasts:      last non-null value strictly before the row
    lags:       value of the row before
    """
    sums, mins, lasts, lags = sums or {}, mins or {}, lasts or {}, lags or {}
    order = [order] if isinstance(order, str) else list(order)
    if chunks is None:
        return df.withColumns(_running(Window.partitionBy(*keys).orderBy(*order), sums, mins, lasts, lags))

    wanted = {**sums, **mins, **lasts, **lags}
    inputs = {f"_in_{n}": e for n, e in wanted.items()}
    cut = df.withColumns(inputs).repartitionByRange(chunks, *keys, *order)
    # The chunk number must not change when a task is run again, so it is fixed in the checkpoint.
    cut = cut_lineage(cut.withColumn("_chunk", F.spark_partition_id()))
    by_chunk = [*keys, "_chunk"]

    place = F.struct(*order)
    folds = [F.sum(f"_in_{n}").alias(f"_f_{n}") for n in sums]
    folds += [F.min(f"_in_{n}").alias(f"_f_{n}") for n in mins]
    folds += [F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_f_{n}") for n in lasts]
    folds += [F.max_by(F.struct(f"_in_{n}"), place).alias(f"_f_{n}") for n in lags]
    along = Window.partitionBy(*keys).orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_f_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carried += [F.min(f"_f_{n}").over(before).alias(f"_c_{n}") for n in mins]
    carried += [F.last(f"_f_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts]
    carried += [F.lag(f"_f_{n}").over(along)[f"_in_{n}"].alias(f"_c_{n}") for n in lags]
    carry = cut.groupBy(*by_chunk).agg(*folds).select(*by_chunk, *carried)

    w = Window.partitionBy(*by_chunk).orderBy(*order)
    local = _running(w, *[{n: F.col(f"_in_{n}") for n in group} for group in (sums, mins, lasts, lags)])
    out = cut.join(carry, on=by_chunk, how="left").withColumns(local | {"_first": F.row_number().over(w) == 1})
    whole = {n: F.col(n) + F.col(f"_c_{n}") for n in sums}
    whole |= {n: F.least(n, f"_c_{n}") for n in mins}
    whole |= {n: F.coalesce(n, f"_c_{n}") for n in lasts}
    whole |= {n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(n)) for n in lags}
    return out.withColumns(whole).drop("_chunk", "_first", *inputs, *[f"_c_{n}" for n in wanted])


def _running(w, sums: Named, mins: Named, lasts: Named, lags: Named) -> Named:
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = {n: F.sum(e).over(upto) for n, e in sums.items()}
    out |= {n: F.min(e).over(upto) for n, e in mins.items()}
    out |= {n: F.last(e, ignorenulls=True).over(before) for n, e in lasts.items()}
    out |= {n: F.lag(e).over(w) for n, e in lags.items()}
    return out
