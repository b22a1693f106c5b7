"""Pairs of token sets by how many tokens they share, on fixed-size identifiers.

A posting is (token, set, size, position): a 64-bit token hash, the 128-bit identifier of the set that holds
it, the set's size, and the token's place in an order that all sets follow. A pair that shares at least
``need`` of left's n tokens meets at left's first ``n - need + 1`` tokens (prefix filter); right must have
``need`` tokens (length filter), and at the first token that they share as many must be left on both
sides (position filter). The sets themselves are fetched for the pairs that survive and compared in full,
so hashes of tokens never decide a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.functions.text import tokens


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``toks``, the token set in sorted order, ``n_toks`` and ``set``, a 128-bit digest of it."""
    named = df.withColumn("toks", F.sort_array(tokens(F.col(text))))
    digest = F.unhex(F.substring(F.sha2(F.array_join("toks", " ").cast("binary"), 256), 1, 32))
    return named.withColumns({"n_toks": F.size("toks"), "set": digest})


def needed(n: Column, threshold: float) -> Column:
    """How many of *n* tokens make a share of *threshold*; one at least."""
    return F.greatest(F.ceil(n * threshold - 1e-9), F.lit(1)).cast("int")


def token_sets(rows: DataFrame, on: Sequence[str], *more: Column) -> DataFrame:
    """Distinct non-empty token sets per *on* of rows with the columns of `with_tokens`: ``set, toks,
    n_toks`` and the aggregates *more*. Copies of a text are one row, however many there are."""
    sets = rows.where("n_toks > 0").groupBy(*on, "set").agg(F.any_value("toks").alias("toks"), *more)
    return sets.withColumn("n_toks", F.size("toks"))


def set_pairs(
    left: DataFrame, right: DataFrame, on: Sequence[str], rarest: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Pairs of token sets ``(on..., lset, rset, shared, score)`` that share at least *need* tokens;
    *score* is the containment of left in right.

    Both sides come from `token_sets`; *left* also has ``need``. *rarest* probes with each left set's
    rarest tokens by their counts in *right*, for joins across documents; otherwise with its longest.
    *keep* names further columns of either side to carry along.
    """
    keys = list(on)
    l = left.where(F.col("need") <= F.col("n_toks"))
    prefix = F.col("n_toks") - F.col("need") + 1
    if rarest:
        mine = _postings(l, keys, "need").drop("pos")
        # Only tokens that some left set has can matter on the right.
        theirs = _postings(right, keys).drop("pos").join(mine.select(*keys, "tok").distinct(), on=[*keys, "tok"], how="left_semi")
        seen = theirs.groupBy("tok").agg(F.count("*").alias("freq"))
        ranked = mine.join(seen, on="tok").groupBy(*keys, "set", "n_toks", "need").agg(
            F.sort_array(F.collect_list(F.struct("freq", "tok"))).alias("x"), F.count("*").alias("known")
        )
        # Tokens that right lacks come first in the order; they are spent without a probe.
        probe = F.slice("x", F.lit(1), F.greatest(prefix - (F.col("n_toks") - F.col("known")), F.lit(0)).cast("int"))
        probes = ranked.select(*keys, "set", "need", F.explode(F.transform(probe, lambda x: x["tok"])).alias("tok"))
        room = F.col("rn") >= F.col("need")
    else:
        probes = _postings(l, keys, "need", first=prefix).select(*keys, "set", "need", "tok")
        theirs = _postings(right, keys)
        room = F.col("rn") - F.col("pos") >= F.col("need")
    postings = theirs.withColumnsRenamed({"set": "rset", "n_toks": "rn"})
    met = probes.withColumnRenamed("set", "lset").join(postings, on=[*keys, "tok"]).where(room).select(*keys, "lset", "rset").distinct()
    mine = left.select(*keys, F.col("set").alias("lset"), F.col("toks").alias("ltoks"), "need", *[c for c in keep if c in left.columns])
    theirs = right.select(*keys, F.col("set").alias("rset"), F.col("toks").alias("rtoks"), *[c for c in keep if c in right.columns])
    both = met.join(mine, on=[*keys, "lset"]).join(theirs, on=[*keys, "rset"])
    both = both.withColumn("shared", F.size(F.array_intersect("ltoks", "rtoks"))).where("shared >= need")
    return both.select(*keys, "lset", "rset", "shared", (F.col("shared") / F.size("ltoks")).alias("score"), *keep)


def _postings(sets: DataFrame, keys: list[str], *more: str, first: Column | None = None) -> DataFrame:
    """Postings of *sets*; of the *first* tokens only, longest token first."""
    by_length = F.array_sort(F.transform("toks", lambda t: F.struct((-F.length(t)).alias("len"), t.alias("t"))))
    some = by_length if first is None else F.slice(by_length, F.lit(1), first.cast("int"))
    hashes = F.transform(some, lambda x: F.xxhash64(x["t"]))
    return sets.select(*keys, "set", "n_toks", *more, F.posexplode(hashes).alias("pos", "tok"))
