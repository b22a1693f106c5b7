"""New files only: the streaming form of "skip a document whose output exists"."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from docstruct.operators.nest import nest
from docstruct.operators.rules import apply_rules
from docstruct.session import cut_lineage

KEYS = ["tag", "doc_id"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_new_blocks(spark: SparkSession, path: str, schema: str, max_files: int = 10_000) -> DataFrame:
    """IO7: block rows of Parquet files that appeared since the last run (kept by the sink's
    checkpoint). A document may lie in files of several batches; see `run_available`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


class _Held(StatefulProcessor):
    """The blocks seen of each document, in the state store. New ones bring all of them out again."""

    def __init__(self, columns: list[str], schema: StructType) -> None:
        self.columns, self.schema = columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getListState("blocks", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [f.name for f in self.schema]
        new = [tuple(r[n] for n in names) for r in rows]
        before = list(self.blocks.get())
        self.blocks.appendList(new)
        for values in (*before, *new):
            known = dict(zip(KEYS, key)) | dict(zip(names, values))
            yield Row(**{c: known[c] for c in self.columns})

    def close(self) -> None:
        pass


def run_available(
    blocks: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda b: apply_rules(nest(b)),
) -> StreamingQuery:
    """Process what is there, then stop.

    The blocks of each document are kept in the query's state store, by document: a batch reads and
    writes the state of the documents it touches and of no others, makes these anew from all of their
    blocks, and appends them as one more version under ``<out>/batch=<number>``. What a batch costs
    does not depend on how much came before it. `latest` reads the result, `compact` leaves out versions
    that are out of date. A batch that runs again after a failure changes nothing. A document's blocks
    pass through one task; documents without identifier are one document.
    """
    spark = blocks.sparkSession
    rest = StructType([f for f in blocks.schema if f.name not in KEYS])
    whole = blocks.groupBy(*KEYS).transformWithState(_Held(blocks.columns, rest), blocks.schema, "Append", "None")

    def each(batch: DataFrame, batch_id: int) -> None:
        made = transform(cut_lineage(batch))  # the state moves on once, however often the batch is read
        made.withColumn("batch", F.lit(batch_id).cast("bigint")).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)

    given = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return whole.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, given) if given else spark.conf.unset(PROVIDER)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every document that `run_available` has written."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    same = [rows[k].eqNullSafe(newest[k]) for k in KEYS]
    return rows.join(newest, [*same, rows["batch"] == newest["batch"]], "left_semi").drop("batch")


def compact(spark: SparkSession, out: str, into: str) -> None:
    """Write the newest version of every document as the only version of another folder, under the
    number of the last batch, so that a query that goes on may write there. For times when none writes."""
    last = spark.read.parquet(out).agg(F.max("batch").alias("batch"))
    latest(spark, out).withColumn("batch", last.scalar()).write.partitionBy("batch").parquet(into)
