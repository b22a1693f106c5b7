"""Mixing documents to target weights of soft domains.

A classifier learned from labeled documents gives every document a posterior over domains. Rates
(how often a document is to be seen) then solve

    minimise  sum_k (sum_d rate_d tokens_d posterior_dk - target_k)^2 / target_k,  rate_d >= 0

from rate 1, in the metric that weighs a document by its tokens: a few projected gradient steps, then
Newton steps for what they leave open. A target below FLOOR of the mix counts as FLOOR of it in the
division, so a domain of weight 0 pulls as a small domain does and not alone. A step needs K domain
totals and the K x K sums of the documents that can still move: one small aggregate over the
documents. A rate is the same function of the posterior for every document, so it is a fold over K
numbers per gradient step and K of the Newton steps; no rates are stored or sent between steps.

Posteriors are soft, so targets can be out of reach: a document that is cut for its toxic part takes
its clean part along. The rates are then those of the minimum, and a warning gives the totals.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.store import written

BUCKETS = 1 << 15
MAX_TRAINING = 20_000
EVIDENCE = 40  # a longer text says as much about its domain as this many words do
STEPS, TOLERANCE = 40, 1e-4  # of steps at most, and of the mix's tokens by which a domain may be off
GRADIENT = 8  # of the steps are gradient steps
FLOOR = 1e-2  # of the mix: a smaller target is weighed as this share
FIRM = 1e6  # of the misses against the distance from the gradient steps' rates, in the Newton steps


def domain_posteriors(
    docs: DataFrame, labeled: DataFrame, domains: Sequence[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
    max_training: int = MAX_TRAINING,
) -> DataFrame:
    """*docs* with further columns tokens (words, split at white space) and posterior (array of a
    probability per domain, in the order given).

    Naive Bayes over BUCKETS hashed words, learned from at most *max_training* rows of *labeled*
    (id, domain; the first by hash of the identifier) whose documents are in *docs*; the domains'
    shares are theirs too. A document with two domains trains nothing,
    nor does a null or unknown one. Empty and null texts have no tokens and get the domains' shares.
    Every row of *docs* gets its row, whatever its identifier.
    """
    own = labeled.select(F.col(id_col).cast("bigint").alias("id"), F.col(domain_col).alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(*domains))
    own = own.groupBy("id").agg(F.min("domain").alias("domain"), F.max("domain").alias("most")).where("domain = most")
    own = own.join(docs.select(F.col(id_col).cast("bigint").alias("id")), "id", "left_semi")
    own = written(own.orderBy(F.xxhash64("id"), "id").limit(max_training).select("id", "domain"), "mixing-labels")
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket")
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\s\x0B]+")
    # max_training rows of two short values, and BUCKETS rows of K numbers: proven bounds.
    seen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.explode(words).alias("w")).where("w <> ''").join(F.broadcast(own), "id")
    counts = seen.groupBy("domain", bucket).agg(F.count("*").alias("n"))
    table = np.ones((BUCKETS, len(domains)))
    for r in counts.collect():
        table[r["bucket"], domains.index(r["domain"])] += r["n"]
    weights = np.log(table / table.sum(0))
    weights -= weights.mean(1, keepdims=True)
    per_domain = {r["domain"]: r["count"] for r in own.groupBy("domain").count().collect()}
    prior = np.log(np.array([per_domain.get(d, 0) + 1.0 for d in domains]) / (sum(per_domain.values()) + len(domains)))

    names = [f"w{k}" for k in range(len(domains))]
    model = docs.sparkSession.createDataFrame([(i, *map(float, row)) for i, row in enumerate(weights)], f"bucket int, {', '.join(f'{n} double' for n in names)}")
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    said = rows.select("_row", F.explode(words).alias("w")).where("w <> ''").select("_row", bucket).join(F.broadcast(model), "bucket")
    said = said.groupBy("_row").agg(F.count("*").alias("_n"), *[F.sum(n).alias(n) for n in names])
    out = rows.join(said, "_row", "left").withColumn("tokens", F.coalesce("_n", F.lit(0)))
    weight = F.least("tokens", F.lit(EVIDENCE)) / F.greatest("tokens", F.lit(1))
    score = [F.lit(float(prior[k])) + F.coalesce(F.col(n), F.lit(0.0)) * weight for k, n in enumerate(names)]
    out = out.withColumn("_s", F.array(*score)).withColumn("_s", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    total = sum((F.get("_s", F.lit(k)) for k in range(len(domains))), F.lit(0.0))
    return out.withColumn("posterior", F.transform("_s", lambda x: x / total)).drop("_row", "_n", "_s", *names)


def fitted_rate(table: DataFrame, weights: Mapping[str, float], whole: str | None = None, max_rate: float | None = None, steps: int = STEPS) -> tuple[Column, dict[str, float]]:
    """(rate as an expression over tokens and posterior of *table*, target tokens per domain).

    *weights* are the domains' shares of the mix, in the order of the posteriors. The mix is so large
    that it holds the tokens of the domain *whole* once, by default as large as no domain has to be
    seen more than once. Rates are
    held at or above 0, and at or below *max_rate* where given. Without tokens all rates are 1.
    """
    shares = np.array(list(weights.values()), float)
    if (shares < 0).any() or not shares.sum():
        raise ValueError("weights are to be nonnegative, and not all zero")
    shares /= shares.sum()
    k = len(shares)
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    gram = table.agg(*[F.sum(F.col("tokens") * p[i] * p[j]) for i in range(k) for j in range(k)], *[F.sum(F.col("tokens") * p[i]) for i in range(k)]).first()
    have = np.array([x or 0.0 for x in gram[k * k :]], float)
    if not have.sum():
        return F.lit(1.0), dict.fromkeys(weights, 0.0)
    names = [whole] if whole else [n for n in weights if weights[n]]
    size = min(have[i] / shares[i] for i, n in enumerate(weights) if n in names)
    target = shares * size
    scale = 1 / np.maximum(target, FLOOR * max(size, 1.0))
    matrix = np.array([x or 0.0 for x in gram[: k * k]], float).reshape(k, k)
    step = 1 / float(np.linalg.eigvalsh(np.sqrt(scale)[:, None] * matrix * np.sqrt(scale)[None, :]).max())
    pulls: list[list[float]] = []

    def held(rate: Column) -> Column:
        rate = F.greatest(rate, F.lit(0.0))
        return rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))

    def rate_of(pulls: list[list[float]]) -> Column:
        after = lambda rate, pull: held(rate - sum((p[i] * F.get(pull, F.lit(i)) for i in range(1, k)), p[0] * F.get(pull, F.lit(0))))
        return F.aggregate(F.lit(pulls), F.lit(1.0), after) if pulls else F.lit(1.0)

    off = np.zeros(k)
    for done in range(steps + 1):
        sums = table.select("tokens", "posterior", rate_of(pulls).alias("rate")).agg(*[F.sum(F.col("rate") * F.col("tokens") * p[i]) for i in range(k)]).first()
        off = np.array([x or 0.0 for x in sums], float) - target
        if np.abs(off).max() <= TOLERANCE * size or done >= min(steps, GRADIENT):
            break
        pulls.append([float(x) for x in step * scale * off])
    left = 0.0  # how far the totals are from those of the minimum
    if np.abs(off).max() > TOLERANCE * size:
        y, off, left = _newton(table, rate_of(pulls), held, p, target, scale * FIRM, off, steps - len(pulls), TOLERANCE * size)
        pulls += [y] if any(y) else []
    if np.abs(off).max() > TOLERANCE * size:
        why = f"not converged in {steps} steps, totals are {left:.4g} from the minimum's" if left > TOLERANCE * size else "targets are out of reach of these documents"
        warnings.warn(f"mixing: {why}; tokens and targets: " + ", ".join(f"{n} {t + o:.0f} of {t:.0f}" for n, t, o in zip(weights, target, off)), stacklevel=2)
    return rate_of(pulls), dict(zip(weights, map(float, target)))


def _newton(table: DataFrame, centre: Column, held, p: list[Column], target: np.ndarray, firm: np.ndarray, off: np.ndarray, steps: int, tolerance: float) -> tuple[list[float], np.ndarray, float]:
    """(pull y, totals less targets, distance of the totals from the minimum's), where the rates
    held(centre - posterior . y) minimise sum_d tokens_d (rate_d - centre_d)^2 + sum_k firm_k off_k^2.

    At the minimum y = firm * off. That is the gradient of a convex function of y with pieces that
    are quadratic, so Newton steps with halving end at it; a trial costs one aggregate.
    """
    k = len(p)
    weigh = table.select("tokens", "posterior", centre.alias("_c"))

    def at(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        to = F.col("_c") - sum((p[i] * float(y[i]) for i in range(1, k)), p[0] * float(y[0]))
        rows = weigh.select("tokens", "posterior", "_c", to.alias("_to"), held(to).alias("_r"))
        free = F.when(F.col("_to") == F.col("_r"), F.col("tokens")).otherwise(F.lit(0))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = rows.agg(
            *[F.sum(F.col("_r") * F.col("tokens") * p[i]) for i in range(k)], F.sum(F.col("tokens") * (F.col("_r") - F.col("_c")) ** 2), *[F.sum(free * p[i] * p[j]) for i, j in pairs]
        ).first()
        off, curve = np.array(r[:k], float) - target, np.diag(1 / firm)
        for (i, j), x in zip(pairs, r[k + 1 :]):
            curve[i, j] += x
            curve[j, i] += x if i != j else 0.0
        return off, curve, float((y * y / firm).sum() / 2 - y @ off - r[k] / 2)

    y = np.zeros(k)
    off, curve, value = at(y)
    while steps > 0:
        slope = y / firm - off
        if np.abs(slope).max() <= tolerance / 10:
            break
        move, length = -np.linalg.solve(curve, slope), 1.0
        while steps > 0:
            steps -= 1
            trial = at(y + length * move)
            if trial[2] <= value + 1e-4 * length * (slope @ move) or length < 1e-6:
                break
            length /= 2
        else:
            break
        y = y + length * move
        off, curve, value = trial
    return [float(x) for x in y], off, float(np.abs(y / firm - off).max())


def mixed(
    docs: DataFrame, labeled: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
    whole: str | None = None, max_rate: float | None = None, seed: int = 5,
) -> DataFrame:
    """*docs* with tokens, posterior, rate and copies: how often the document stands in the mix.

    copies is the rate rounded up with the probability of its fraction, by a hash of the identifier
    and *seed*: the same on every run, on average the rate. Rows that repeat an identifier get the
    same copies, a null identifier has a hash of its own. An empty table gives an empty result.
    Columns of *docs* that bear the names of the new ones are replaced.
    """
    docs = docs.drop("tokens", "posterior", "rate", "copies")
    table = written(domain_posteriors(docs, labeled, list(weights), id_col, text_col, domain_col), "mixing-posteriors")
    rate, _ = fitted_rate(table.select("tokens", "posterior"), weights, whole, max_rate)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    out = table.withColumn("rate", rate)
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))

