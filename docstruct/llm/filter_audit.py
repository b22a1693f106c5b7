"""What each filter of a chain removes, in every order of the filters, from wide packed counters.

A document is reduced to the mask of the filters it fails. For every mask (and every label) there is
one big integer whose 64-bit fields say what happens to such a document at each step of all 120
orders: kept, removed, redundant, good lost, toxic lost. Adding the integers of a part's documents
adds all 3,000 counters at once; a field holds up to 2**64 - 1 documents, so none spills into the
next. Sums of tasks are added per part in two rounds and unpacked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.store import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
COUNTERS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
FIELD_BYTES = 8

#: Sums that a task holds at once before it passes them on; a sum takes 24 KB.
PARTS_IN_TASK = 1_000

#: Characters that stand between words, and markup characters of filter D.
BLANKS = " \t\n\x0b\x0c\r"
MARKUP = r"[#$%&*|]"


def failures(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of *docs*: id, part, mask (bit i set: fails filter i of ABCDE).

    A null text is empty (it fails A, not B: no words are not fewer than half of none) and equal to
    other empty texts. A null identifier is not smaller than any other and has no smaller one, so
    such a row neither fails E nor makes others fail; rows that repeat the smallest identifier of a
    text all pass E. A null source is the part of the empty string. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    own: list[Column] = [
        F.size("words") < 200,
        100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        100 * capitals.cast("bigint") > 2 * F.length(text),
        text.rlike(MARKUP),
    ]
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(own)), F.lit(0))
    rows = docs.withColumn("words", words).select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce("source", F.lit("")).alias("part"), bits.alias("own"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.octet_length(text).alias("size"),
    )
    # Read twice below; a written table is also what lets a join split the copies of one text.
    rows = written(rows, "filter-rows")
    first = rows.groupBy("sha", "size").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    first = written(first.select("sha", "size", "first"), "filter-copies")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.join(first, ["sha", "size"], "left").select("id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document without label row, or with a null label, is neither good nor toxic; one with several
    label rows is what any of them says. An empty table gives no rows.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    rows = failures(docs, id_col).join(marks, "id", "left").select(
        "part", (F.col("mask") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0))).alias("kind")
    )
    sums = rows.mapInArrow(_packed, "part string, salt int, packed binary")
    near = sums.repartition(F.col("part"), F.col("salt")).sortWithinPartitions("part").mapInArrow(_added, "part string, packed binary")
    whole = near.repartition("part").sortWithinPartitions("part").mapInArrow(_added, "part string, packed binary")
    schema = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return whole.mapInArrow(_unpacked, schema)


def wide_integers() -> list[int]:
    """The integer of each kind (mask + 32 if good + 64 if toxic): field 5 * step + counter is 1
    where the counter of that step counts such a document."""
    kinds = []
    for kind in range(128):
        mask, good, toxic = kind & 31, kind >> 5 & 1, kind >> 6
        fields = np.zeros((len(STEPS), len(COUNTERS)), f"<u{FIELD_BYTES}")
        for at, (order, step) in enumerate(STEPS):
            fails = [mask >> FILTERS.index(f) & 1 for f in order[: step + 1]]
            gone, here = any(fails[:-1]), fails[-1]
            removed = here and not gone
            fields[at] = (not gone and not here, removed, here and gone, removed and good, removed and toxic)
        kinds.append(int.from_bytes(fields.tobytes(), "little"))
    return kinds


def _bytes(total: int) -> bytes:
    return total.to_bytes(len(STEPS) * len(COUNTERS) * FIELD_BYTES, "little")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sum per part of this task's rows."""
    from pyspark import TaskContext

    salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % 64
    wide, sums = wide_integers(), {}
    for batch in batches:
        codes = batch.column("part").dictionary_encode()
        parts = codes.dictionary.to_pylist()
        for part, kind in zip(codes.indices.to_numpy(), batch.column("kind").to_numpy()):
            name = parts[part]
            sums[name] = sums.get(name, 0) + wide[kind]
            if len(sums) > PARTS_IN_TASK:
                yield from _rows(sums, salt)
                sums = {}
    yield from _rows(sums, salt)


def _rows(sums: dict[str, int], salt: int | None = None) -> Iterator[pa.RecordBatch]:
    names = list(sums)
    for start in range(0, len(names), 256):
        some = names[start : start + 256]
        columns = {"part": pa.array(some, pa.string())} | ({} if salt is None else {"salt": pa.array([salt] * len(some), pa.int32())})
        yield pa.RecordBatch.from_pydict(columns | {"packed": pa.array([_bytes(sums[n]) for n in some], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of parts that come sorted, one part at a time."""
    open_part, total = None, 0
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed")):
            if part != open_part:
                if open_part is not None:
                    yield from _rows({open_part: total})
                open_part, total = part, 0
            total += int.from_bytes(packed.as_py(), "little")
    if open_part is not None:
        yield from _rows({open_part: total})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = pa.array([order for order, _ in STEPS], pa.string())
    steps = np.array([step + 1 for _, step in STEPS], np.int32)
    filters = np.array([FILTERS.index(order[step]) for order, step in STEPS])
    last = steps == len(FILTERS)
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed")):
            fields = np.frombuffer(packed.as_py(), f"<u{FIELD_BYTES}").reshape(len(STEPS), len(COUNTERS)).astype(np.int64)
            count = dict(zip(COUNTERS, fields.T))
            shapley = np.array([count["removed"][filters == f].sum() for f in range(len(FILTERS))])
            # What the last step of an order removes has passed all other filters.
            unique = np.array([count["removed"][(filters == f) & last][0] for f in range(len(FILTERS))])
            columns = {
                "part": pa.array([part] * len(STEPS), pa.string()), "filter_order": orders, "step": steps, "kept": count["kept"], "removed": count["removed"],
                "redundant": count["redundant"], "unique_fails": unique[filters], "good_lost": count["good_lost"], "toxic_lost": count["toxic_lost"],
                "shapley": shapley[filters],
            }
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v)) for k, v in columns.items()})
