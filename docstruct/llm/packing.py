"""Packing documents into sequences of a fixed number of tokens by linear grouping.

Lengths are whole numbers up to the sequence length, so a table of counts by length says all that the packing
needs; it has at most 2,048 rows whatever the corpus. From it the driver

1. sorts the large lengths, cuts them into groups of equal cardinality, rounds each up to its group's largest,
2. finds the configurations (how many of each rounded size share a sequence) by linear programming with generated
   columns, and fills the whole number of sequences of each,
3. substitutes actual lengths for rounded ones, which tells the room left in each sequence,
4. places what is left over of the large ones, then the small ones, longest first, each into the sequence with the
   least room that holds it, opening a sequence where none does.

Sequences that look alike are handled as runs, so the plan is a bounded table of runs too. Pieces get a rank among
those of their length from counts per task, and find their place in the plan by arithmetic: no group of pieces is
ever gathered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.llm.store import written

#: Lengths of at most this share of a sequence are small: best-fit places them into what is left.
SMALL = 1 / 3
GROUPS = 256

#: Distinct words whose ids a task keeps; beyond that it starts anew.
CACHED_WORDS = 1_000_000
CHUNK_BYTES = 1 << 21
PUNCTUATION = b".,;:!?"
#: Letters up to U+00FF: case and composition keep each of them one letter.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", end: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the task and rank among the task's pieces of
    that length. Documents end with the id *end*; only longer ones than *capacity* are cut."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ids = rows.schema["id"].dataType.simpleString()
    schema = f"id {ids}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast({"vocabulary": f.read()})  # a few MB
    return rows.mapInArrow(_cut(model, capacity, end), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id alone. Rows that share an identifier, or have none, are packed each
    for itself. Equal lengths are told apart by where they were read, so runs may number sequences differently;
    their count depends on the lengths only. An empty table gives an empty result; further columns are ignored.
    """
    cut = written(pieces(docs, tokenizer, capacity, id_col), "packing-pieces")
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task and length: the rows of a length are as many as the tasks.
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    plan = docs.sparkSession.sparkContext.broadcast(plan_runs(totals, capacity))
    ids = cut.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(_placed(plan), f"id {ids}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id_col)


class Words:
    """Token ids of texts, word by word: white space and the vocabulary's own rules separate words, so a text's
    ids are those of its words one after the other. Words keep a number, at which their ids lie in one array."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = Numbered()
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of *texts* in a row, and how many each text has."""
        if len(self.known) > CACHED_WORDS:
            self.clear()
        # Of bytes: ASCII letters and white space only. Special tokens are matched before letters are lowered.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        counts = [len(words) for words in split]
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        self._learn()
        ids, ends = self._joined(words)
        return ids, np.diff(np.concatenate(([0], ends))[np.cumsum(counts, dtype=np.int64)], prepend=0)

    def _joined(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and where each word's end."""
        n = self.sizes[words]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[words] - (ends - n), n)], ends

    def _learn(self) -> None:
        """The ids of the words that got a number since the last call."""
        at, names = len(self.sizes), self.known.names
        if at == len(names):
            return
        # Vocabulary rules always part a letter or digit from the punctuation after it.
        split = {}
        for number in range(at, len(names)):
            stem = names[number].rstrip(PUNCTUATION)
            if len(stem) < len(names[number]) and stem[-1:].isalnum():
                split[number] = self.known[stem], self.known[names[number][len(stem) :]]
        whole = [k for k in range(at, len(names)) if k not in split]
        letters = [k for k in whole if LETTERS(names[k])]
        others = sorted({*whole}.difference(letters))
        found = [e.ids for e in self.tokenizer.encode_batch_fast([names[k].decode("utf-8", "replace") for k in others], add_special_tokens=False)]
        # Runs of letters are encoded in one text; each ends with the only id of its own that closes a run.
        run = b" ".join([names[k] for k in letters]).decode()
        run = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids if letters else [], np.uint32)
        ends = np.flatnonzero(self.closes[run]) + 1
        sizes = np.zeros(len(names), np.int64)
        sizes[:at] = self.sizes
        sizes[others] = [len(ids) for ids in found]
        sizes[letters] = np.diff(ends, prepend=0)
        order = np.array(others + letters, np.int64)
        starts = np.zeros(len(names), np.int64)
        starts[:at] = self.starts
        starts[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32), run])
        self.starts, self.sizes = starts, sizes
        if split:
            numbers = np.fromiter(split, np.int64)
            ids, ends = self._joined(np.array([*split.values()], np.int64).ravel())
            ends = ends[1::2]
            self.sizes[numbers] = np.diff(ends, prepend=0)
            self.starts[numbers] = len(self.flat) + ends - self.sizes[numbers]
            self.flat = np.concatenate([self.flat, ids])


class Numbered(dict):
    """Words by number; a word not seen before gets the next one."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


def _cut(model, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        # A worker's later tasks find the words that its earlier ones have met.
        words, seen = model.value.setdefault("words", None) or Words(model.value["vocabulary"]), np.zeros(capacity + 1, np.int64)
        model.value["words"] = words
        for batch in batches:
            start = 0
            sizes = pc.binary_length(batch.column("text")).to_numpy()
            while start < batch.num_rows:
                stop, size = start, 0
                while stop < batch.num_rows and (stop == start or size + sizes[stop] <= CHUNK_BYTES):
                    size += sizes[stop]
                    stop += 1
                ids, n = words.encode(batch.column("text").slice(start, stop - start).to_pylist())
                yield _piece_rows(batch.column("id").slice(start, stop - start), ids, n, capacity, end, task, seen)
                start = stop

    return run


def _piece_rows(names: pa.Array, ids: np.ndarray, n: np.ndarray, capacity: int, end: int, task: int, seen: np.ndarray) -> pa.RecordBatch:
    of, piece, start, length, crc = [], [], [], [], []
    at = 0
    for row, size in enumerate(n.tolist()):
        document = np.append(ids[at : at + size], end).astype("<u4")
        at += size
        for k, first in enumerate(range(0, size + 1, capacity)):
            part = document[first : first + capacity]
            of.append(row)
            piece.append(k)
            start.append(first)
            length.append(len(part))
            crc.append(zlib.crc32(part.tobytes()))
    length = np.array(length, np.int64)
    rank = np.empty(len(length), np.int64)  # among the task's pieces of this length, in reading order
    order = np.argsort(length, kind="stable")
    groups, first, count = np.unique(length[order], return_index=True, return_counts=True)
    rank[order] = np.arange(len(length)) - np.repeat(first, count) + np.repeat(seen[groups], count)
    seen[groups] += count
    columns = {
        "id": names.take(pa.array(of, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length),
        "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array([task] * len(of), pa.int32()), "rank": pa.array(rank),
    }
    return pa.RecordBatch.from_pydict(columns)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """How many sequences of which configuration: (copies of each size, sequences). A basic solution of the linear
    program over all configurations, each rounded down, so a few items of each size stay without a place."""
    m = len(sizes)
    if not m:
        return []
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // size).astype(float)  # one configuration per size to begin with
    for _ in range(40 * m):
        values = np.linalg.solve(basis.T, np.ones(m))
        column, worth = _best_configuration(size, np.maximum(values, 0), capacity)
        if worth <= 1 + 1e-9:
            break
        amount, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        rising = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[rising] = np.maximum(amount[rising], 0) / step[rising]
        basis[:, int(np.argmin(ratio))] = column
    amount = np.linalg.solve(basis, need)
    left, chosen = np.array(demand, np.int64), []
    for column, x in zip(basis.T.astype(np.int64), amount):
        used = column > 0
        count = int(min(np.floor(x + 1e-6), (left[used] // column[used]).min()))
        if count > 0:
            chosen.append((column, count))
            left -= column * count
    return chosen


def _best_configuration(size: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the greatest value: a knapsack, one more item per layer, all rooms at once."""
    layers = [np.zeros(capacity + 1)]
    while len(layers) <= capacity // int(size.min()):
        last, best = layers[-1], layers[-1].copy()
        for s, v in zip(size.tolist(), values.tolist()):
            np.maximum(best[s:], last[: capacity + 1 - s] + v, out=best[s:])
        layers.append(best)
    column, room = np.zeros(len(size)), capacity
    for last, best in zip(layers[-2::-1], layers[:0:-1]):
        if best[room] == last[room]:
            continue
        fits = np.flatnonzero(size <= room)
        k = int(fits[np.argmax(last[room - size[fits]] + values[fits])])
        column[k] += 1
        room -= int(size[k])
    return column, float(column @ values)


def plan_runs(totals: dict[int, int], capacity: int, small: float = SMALL, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """Where every piece goes, as runs sorted by (length, first): pieces of *length* with ranks from *first* on,
    *n* of them, *per* in a sequence, lie in the sequences from *sequence* on at *offset*, then *offset* + length."""
    lengths = sorted((x for x, n in totals.items() if n), reverse=True)
    large = [x for x in lengths if x > capacity * small]
    runs: list[tuple[int, int, int, int, int, int]] = []  # length, first, n, per, sequence, offset
    # Places in the order of decreasing length; a length's ranks lie in one stretch of it.
    at, stretch = 0, {}
    for x in large:
        stretch[x] = at
        at += totals[x]
    total = at
    bounds = np.unique(np.linspace(0, total, min(groups, max(len(large), 1)) + 1).astype(np.int64)) if total else np.zeros(1, np.int64)
    starts = np.array([stretch[x] for x in large], np.int64)
    longest = [large[int(np.searchsorted(starts, b, "right")) - 1] for b in bounds[:-1]]
    # Groups rounded to one size are one group.
    cuts = [i for i in range(len(longest)) if i == 0 or longest[i] != longest[i - 1]]
    firsts = [int(bounds[i]) for i in cuts]
    demand = np.diff([*firsts, total]).tolist()
    chosen = configurations([longest[i] for i in cuts], demand, capacity)
    taken, sequence = np.zeros(len(cuts), np.int64), 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, n) with that room
    edges = np.array([*starts, total]) if total else np.zeros(1, np.int64)
    for column, count in chosen:
        used = np.flatnonzero(column)
        slots = [(int(firsts[g] + taken[g] + s * count)) for g in used for s in range(int(column[g]))]
        # Sequence t takes place slot + t of each slot; lengths change only at the edges of stretches.
        marks = np.unique(np.concatenate([[0, count], *[edges[(edges > s) & (edges < s + count)] - s for s in slots]]).astype(np.int64))
        for t, upto in zip(marks[:-1].tolist(), marks[1:].tolist()):
            offset = 0
            for s in slots:
                x = large[int(np.searchsorted(starts, s + t, "right")) - 1]
                runs.append((x, s + t - stretch[x], upto - t, 1, sequence + t, offset))
                offset += x
            rooms.setdefault(capacity - offset, []).append((sequence + t, upto - t))
        taken[used] += column[used] * count
        sequence += count
    # What the configurations left over, as (length, first rank, n).
    rest: dict[int, list[tuple[int, int]]] = {x: [(0, totals[x])] for x in lengths if x not in stretch}
    for g, first in enumerate(firsts):
        place, stop = first + int(taken[g]), first + demand[g]
        while place < stop:
            k = int(np.searchsorted(starts, place, "right")) - 1
            upto = min(stop, int(edges[k + 1]))
            rest.setdefault(large[k], []).append((place - stretch[large[k]], upto - place))
            place = upto
    for x in sorted(rest, reverse=True):
        for first, n in rest[x]:
            while n:
                room = min((r for r in rooms if r >= x), default=None)
                if room is None:  # new sequences, each filled with as many as it holds
                    per = min(capacity // x, n)
                    runs.append((x, first, n // per * per, per, sequence, 0))
                    rooms.setdefault(capacity - per * x, []).append((sequence, n // per))
                    sequence += n // per
                    first, n = first + n // per * per, n % per
                    continue
                begin, here = rooms[room].pop()
                per = min(room // x, n)  # the fullest that fits is still the fullest after one more
                here_used = min(here, n // per)
                runs.append((x, first, here_used * per, per, begin, capacity - room))
                rooms.setdefault(room - per * x, []).append((begin, here_used))
                if here > here_used:
                    rooms[room].append((begin + here_used, here - here_used))
                if not rooms[room]:
                    del rooms[room]
                first, n = first + here_used * per, n - here_used * per
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    return dict(zip(("length", "first", "n", "per", "sequence", "offset"), table.T.copy()))


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of these lengths and ranks."""
    width = int(max(plan["first"].max(initial=0), rank.max(initial=0))) + 1
    run = np.searchsorted(plan["length"] * width + plan["first"], length * width + rank, "right") - 1
    inside = rank - plan["first"][run]
    per = plan["per"][run]
    return plan["sequence"][run] + inside // per, plan["offset"][run] + inside % per * length


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = place(plan.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run
