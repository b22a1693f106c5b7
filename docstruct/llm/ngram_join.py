"""Exact n-gram Jaccard self-join and its connected components.

Texts with equal shingle sets are one class; classes are joined through tiles. A tile is a rare
shingle, or a frequent shingle within a band of set sizes. Inside a tile a bitmap of the set bounds
the overlap from above (a bit that differs is a shingle not shared), and only pairs that pass are
read again and intersected exactly as sorted arrays.

Which shingles open tiles: two sets that link at threshold t share one of the first
p = n - ceil(t n) + 1 shingles of each in any common order. The first half again of hash order is
indexed; their document counts are exact. Where at least p of a set's indexed shingles are rare
(at most `rare` sets), any partner of the same kind shares a rare one, so frequent tiles are needed
only for sets that are mostly made of frequent shingles, against all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.llm.components import components
from docstruct.llm.shingles import U, mix, shingle_sets
from docstruct.llm.store import written

RARE = 64
BITS = 16  # longs of a bitmap
BLOCK = 4096  # sets of a block of a frequent tile, and open sets of a part
NEAR, TILE = 4, 1000  # neighbours and typical sets tried first in a frequent tile; rows of the parts it is cut into for that

SETS = f"id bigint, n int, k1 bigint, k2 bigint, tokens array<bigint>, bands array<struct<band:int,{','.join(f'b{i}:bigint' for i in range(BITS))}>>"


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5, rare: int = RARE,
) -> DataFrame:
    """One row per row of *docs*: id, n_shingles, component_id.

    Two texts link when their sets of *words*-word shingles (of whole texts, A-Z lower-cased, words
    split at white space) have a Jaccard similarity of num/den or more; component_id is the smallest
    identifier reachable by links, the own one included. A null or blank text has no shingles and
    links with nothing. Equal sets link whatever their number. Rows that repeat an identifier get
    the same row each; a null identifier gets the smallest of its component, null if there is none.
    An empty table gives an empty result; further columns of *docs* are ignored.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sets = written(docs.mapInArrow(_sets(words, num, den), SETS), "ngram-sets")
    classes = sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = written(classes, "ngram-classes")
    links = _links(docs, sets, classes, words, num, den, rare)
    roots = components(links)
    members = sets.select("id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"], "left")
    return members.join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component_id")
    )


def _links(docs: DataFrame, sets: DataFrame, classes: DataFrame, words: int, num: int, den: int, rare: int) -> DataFrame:
    """(a, b) for the pairs of class representatives that link."""
    one = classes.where("rep IS NOT NULL").select(F.col("rep").alias("id"), "n", "m")
    reps = sets.where("n > 0").drop("k1", "k2")
    reps = written(reps.join(one, ["id", "n"]), "ngram-reps")
    tokens = reps.select("id", "n", F.posexplode("tokens").alias("pos", "token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = written(tokens.join(counts, "token"), "ngram-tiles")

    few, often = shared.where(F.col("c") <= rare), shared.where(F.col("c") > rare)
    hot = often.groupBy("id").agg(F.count("*").cast("int").alias("hot"))
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    card = reps.select("id", "n", "m", "bands", F.size("tokens").alias("indexed")).join(hot, "id", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    card = written(card.withColumn("open", F.col("indexed") - F.col("hot") < prefix), "ngram-cards")

    # Rare tiles: every pair, with how many indexed shingles it shares.
    x = few.select("token", F.col("id").alias("a"), F.col("n").alias("n_a"))
    y = few.select("token", F.col("id").alias("b"), F.col("n").alias("n_b"))
    near = x.join(y, "token").where((F.col("a") < F.col("b")) & _sizes(num, den)).groupBy("a", "b").agg(F.count("*").alias("c"))

    # Frequent tiles: sets that may have too few rare shingles, against all in the same size band.
    # First each set with its next neighbours by size and with the tile's most typical sets (of the
    # most frequent shingles and copies). That joins a family of near copies around its original, so
    # that the full comparison afterwards needs no pair within what is joined already.
    wide = often.where(F.col("pos") < prefix).select("token", "id", "c").join(card, "id")
    banded = wide.select("token", "c", "id", "n", "open", (F.col("hot") / F.col("indexed")).alias("typical"), "m", F.explode("bands.band").alias("band"))
    tile = Window.partitionBy("token", "band", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / TILE)))
    along = tile.orderBy("n", "id")
    first = tile.orderBy(F.desc("typical"), F.desc("m"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tried = [F.lead("id", k).over(along) for k in range(1, NEAR + 1)] + [F.nth_value("id", k).over(first) for k in range(1, NEAR + 1)]
    thin = banded.withColumn("tried", F.array(*tried)).select(F.col("id").alias("x"), F.explode("tried").alias("y"))
    thin = thin.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(None).cast("bigint").alias("c")).distinct()

    side = lambda s: card.select(*[F.col(c).alias(f"{c}_{s}") for c in ("n", "bands", "indexed", "hot", "open")], F.col("id").alias(s))
    near = near.union(thin).join(side("a"), "a").join(side("b"), "b").where(_sizes(num, den))
    # The set whose index reaches less far shares all of its indexed shingles but those it may lack.
    least = [F.col(f"indexed_{s}") - F.col(f"hot_{s}") - (F.col(f"n_{s}") - _overlap(num, den)) for s in "ab"]
    near = near.where((F.col("c") >= F.least(*least)) | (F.col("c").isNull() & (F.col("open_a") | F.col("open_b"))))
    # A pair lies in one or two bands; both lists stay in its row.
    fits = F.exists("bands_a", lambda x: F.exists("bands_b", lambda y: (x["band"] == y["band"]) & _bound(x, y, num, den)))
    links = written(_exact(docs, near.where(fits).select("a", "b"), words, num, den), "ngram-links")

    # What is left has an open set on one side and two components. Tiles without are done; of the others each set
    # stands in one block, and the open ones, in parts, pass by all blocks. A task compares a part with a block as
    # matrices of bitmaps; only then do the bitmaps travel.
    mine = often.where(F.col("pos") < prefix).groupBy("id").agg(F.collect_list("token").alias("mine"))
    roots = components(links).select(F.col("node").alias("id"), "root")
    slim = often.where(F.col("pos") < prefix).select("token", "id").join(card.select("id", "n", "open", F.explode("bands.band").alias("band")), "id")
    slim = written(slim.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "ngram-slim")
    tiles = slim.groupBy("token", "band").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("open") / BLOCK).cast("int").alias("parts"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    ).where("parts > 0 AND low < high").drop("low", "high")
    dealt = slim.join(tiles, ["token", "band"]).withColumns(
        {"own": F.pmod(F.xxhash64("id"), "blocks").cast("int"), "part": F.pmod(F.xxhash64(F.lit(1), "id"), "parts").cast("int")}
    )
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, probe: F.struct(i.alias("i"), j.alias("j"), F.lit(probe).alias("probe"))
    stands = F.transform(upto("parts"), lambda j: place(F.col("own"), j, False))
    passes = F.when(F.col("open"), F.transform(upto("blocks"), lambda i: place(i, F.col("part"), True)))
    bits = F.struct(*[F.col(f"b{i}") for i in range(BITS)]).alias("bits")
    maps = card.select("id", F.inline("bands")).select("id", "band", bits)
    dealt = dealt.join(maps, ["id", "band"]).join(mine, "id").withColumn("at", F.explode(F.concat(stands, F.coalesce(passes, F.array()))))
    dealt = dealt.select("token", "band", "at.*", "id", "n", "root", "open", "mine", "bits")
    far = dealt.groupBy("token", "band", "i", "j").applyInArrow(_tile(num, den), "a bigint, b bigint")
    return links.union(_exact(docs, far, words, num, den))


def _exact(docs: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link, from the whole sets of their whole texts."""
    pairs = written(pairs.distinct(), "ngram-pairs")
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ngram-ids")
    whole = docs.join(ids, "id", "left_semi").mapInArrow(_whole(words), "id bigint, hashes array<bigint>")
    whole = written(whole.dropDuplicates(["id"]), "ngram-whole")
    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(whole.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified(num, den), "a bigint, b bigint")


def _overlap(num: int, den: int) -> Column:
    """Fewest shared shingles of a link: i / (n_a + n_b - i) >= num / den."""
    return F.ceil((F.col("n_a") + F.col("n_b")) * num / F.lit(num + den))


def _sizes(num: int, den: int) -> Column:
    return F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num


def _bound(x: Column, y: Column, num: int, den: int) -> Column:
    """Whether the bitmaps x and y leave room for a link."""
    differ = sum((F.bit_count(x[f"b{i}"].bitwiseXOR(y[f"b{i}"])) for i in range(BITS)), F.lit(0))
    return (F.col("n_a") + F.col("n_b") - differ) >= 2 * _overlap(num, den)


def _tile(num: int, den: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        token = key[0].as_py()
        rows = rows.sort_by([("n", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, n, root = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "root"))
        is_open, probe = (rows.column(c).to_numpy() for c in ("open", "probe"))
        bits = np.stack([x.to_numpy() for x in rows.column("bits").combine_chunks().flatten()], 1).view(np.uint64)
        earlier = [frozenset(t for t in x if t < token) for x in rows.column("mine").to_pylist()]
        found: list[tuple[int, int]] = []
        chosen, standing = np.flatnonzero(probe), np.flatnonzero(~probe)
        sizes = n[standing]
        for start in range(0, len(chosen), 128):
            left = chosen[start : start + 128]
            low, high = np.searchsorted(sizes, -(-n[left[0]] * num // den), "left"), np.searchsorted(sizes, n[left[-1]] * den // num, "right")
            right = standing[low:high]
            total = n[left][:, None] + n[right][None, :]
            room = total - 2 * -(-total * num // (num + den))
            fit = (root[left][:, None] != root[right][None, :]) & (np.minimum(n[left][:, None], n[right]) * den >= np.maximum(n[left][:, None], n[right]) * num)
            fit &= ~is_open[right][None, :] | (ids[left][:, None] < ids[right][None, :])
            if not fit.any():
                continue
            differ = np.zeros(total.shape, np.int64)
            for k in range(BITS):
                differ += np.bitwise_count(bits[left, k][:, None] ^ bits[right, k][None, :])
            for x, y in zip(*np.nonzero(fit & (differ <= room))):
                p, q = left[x], right[y]
                if earlier[p].isdisjoint(earlier[q]):  # a pair that shares several tiles comes from the first
                    found.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    return run


def _bitmap(a: np.ndarray, band: int) -> np.ndarray:
    """1024 bits of the set's hashes; of larger sets only a share by hash, the same for all in the band."""
    share = min(2, max(0, band - 9))
    a = a[(a >> U(10)) & U((1 << share) - 1) == 0]
    bits = np.zeros(64 * BITS, np.uint8)
    bits[(a & U(64 * BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sets(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, tokens, ends, maps, map_ends = [], [], [], [], [0], [], [0]
            for a in shingle_sets(batch.column("text"), words):
                size = len(a)
                n.append(size)
                k1.append(int(mix(a ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                k2.append(int(mix(a + U(0x632BE59BD9B4E019)).sum(dtype=np.uint64)))
                prefix = size + (-num * size // den) + 1 if size else 0
                kept = a[: prefix + max(2, prefix // 2)]
                tokens.append(kept.view(np.int64))
                ends.append(ends[-1] + len(kept))
                if size:
                    band = size.bit_length() - 1
                    for b in [band] + [band + 1] * (size * den >= (2 << band) * num):
                        maps.append((b, _bitmap(a, b)))
                map_ends.append(len(maps))
            bits = np.array([m for _, m in maps], np.int64).reshape(-1, BITS)
            bands = pa.StructArray.from_arrays(
                [pa.array([b for b, _ in maps], pa.int32()), *[pa.array(bits[:, i]) for i in range(BITS)]], ["band", *[f"b{i}" for i in range(BITS)]]
            )
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(n, pa.int32()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.ListArray.from_arrays(pa.array(map_ends, pa.int32()), bands),
                ],
                ["id", "n", "k1", "k2", "tokens", "bands"],
            )

    return run


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [a.view(np.int64) for a in shingle_sets(batch.column("text"), words)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "hashes"])

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = batch.column("x")[i].values.to_numpy(), batch.column("y")[i].values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared * den >= (len(x) + len(y) - shared) * num)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run
