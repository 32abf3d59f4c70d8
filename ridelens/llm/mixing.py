"""Mixing to target weights with soft domain membership; DataFrame functions only.

A labelled table trains a naive Bayes classifier whose counts are one aggregate over hashed tokens. Every
document then belongs to each domain with its posterior. Document rates r >= 0 minimise
`sum_d (sum_i r_i n_i p_id - target_d)^2` by projected gradient steps, taken in the metric of the Gram
matrix of the memberships. A step needs a few sums over all documents; as the rate of a document is a
function of its own memberships and the steps so far, no state per document is carried between steps.

With a bound on rates nothing can be repeated, so the weights are read as shares: the first domain is the clean
one, its documents stay whole, and the others are thinned until none exceeds its share of what is kept.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import register, table

BUCKETS = 1 << 16  # hashed tokens, and so the rows of the classifier that are broadcast
BROADCAST_ROWS = 400_000  # labelled rows are broadcast up to this number, joined beyond
PASS_ROWS = 20_000  # about the rows of a task in a pass over the memberships, which are short rows
TRIES = 6  # steps of different lengths that one pass over the memberships tries
STRENGTH, EFFECTIVE = 20.0, 100.0  # pseudo-counts of a bucket; tokens after which further ones weigh less


def tokens(text: Column) -> Column:
    """Lower-cased words and the marks that follow them."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+|(?<=\p{L})(?=[^\p{L}\s])"), "")


def _bag(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """A row per document and distinct token: id, n (all tokens of the document), k (distinct ones), bucket (null without tokens)."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, tokens(F.col(text_col)).alias("t"))
    rows = rows.select("id", *keep, F.size("t").cast("long").alias("n"), F.array_distinct("t").alias("t"))
    rows = rows.select("id", *keep, "n", F.size("t").alias("k"), F.explode_outer("t").alias("t"))
    return rows.select("id", *keep, "n", "k", F.when(F.col("t").isNotNull(), F.pmod(F.xxhash64("t"), F.lit(BUCKETS))).alias("bucket"))


def classifier(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...): log of how much likelier a bucket is in a domain than at all; and the log priors."""
    few = labels.count() <= BROADCAST_ROWS
    held = docs.join(F.broadcast(labels) if few else labels, id_col)
    known = _bag(held, id_col, text_col, "domain").where("n > 0")
    counts = known.groupBy("bucket").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"c{i}") for i, d in enumerate(domains)]).checkpoint()
    sums = counts.agg(*[F.sum(f"c{i}") for i in range(len(domains))]).first()
    size = [float(x or 0) + 1.0 for x in sums]
    share = [s / sum(size) for s in size]
    found = {r["domain"]: r["count"] for r in labels.groupBy("domain").count().collect()}
    prior = [(found.get(d, 0) + 1.0) for d in domains]
    every = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0))
    weights = [F.log((F.col(f"c{i}") + STRENGTH * p) / ((every + STRENGTH) * p)).alias(f"w{i}") for i, p in enumerate(share)]
    return counts.select("bucket", *weights), [float(np.log(p / sum(prior))) for p in prior]


def memberships(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, p0, p1, ...) of every id: its tokens and domain posteriors; rows of one id count together."""
    weights, prior = classifier(docs, labels, domains, id_col, text_col)
    every = range(len(domains))
    rows = _bag(docs, id_col, text_col).join(F.broadcast(weights), "bucket", "left")
    sums = rows.groupBy("id").agg(F.max("n").alias("n"), F.max("k").alias("k"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in every])
    scale = F.least(F.lit(1.0), F.lit(EFFECTIVE) / F.greatest("k", F.lit(1)))
    sums = sums.select("id", "n", *[(F.lit(prior[i]) + scale * F.col(f"s{i}")).alias(f"l{i}") for i in every])
    top = F.greatest(*[f"l{i}" for i in every]) if len(domains) > 1 else F.col("l0")
    sums = sums.select("id", "n", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in every])
    whole = sum((F.col(f"e{i}") for i in every), F.lit(0.0))
    return sums.select("id", "n", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in every])


def fit_rates(members: DataFrame, weights: list[float], most: float | None = None, steps: int = 25, close: float = 1e-4) -> Column:
    """The rate of a document as a column over `members`.

    Targets are `weights` of all tokens there are. Stops when every domain is within `close` of its target
    (relative to all tokens) or no step helps; targets out of reach are met as closely as least squares can.

    With a bound `most` the rows of `members` that are `clean` have that rate whatever the others need, and the
    weights after the first are upper shares of the tokens kept (`caps`): the other rows are thinned until no
    domain exceeds its share, and a domain that is short of it is not thinned and thins no other.
    """
    every = range(len(weights))

    def bounded(r: Column) -> Column:
        r = F.greatest(F.lit(0.0), r)
        return r if most is None else F.when(F.col("clean"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), r))

    def step(r: Column, move: np.ndarray) -> Column:
        return bounded(r - sum((F.col(f"p{i}") * float(move[i]) for i in every), F.lit(0.0)))

    def sums(rate: Column, moves: list[np.ndarray], bound: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens of the domains and the Gram matrix of the free rows after each of `moves` from `rate`, in one pass."""
        asked = []
        for k in range(len(moves)):
            r = F.col(f"r{k}")
            free = (r > 0) & (F.lit(True) if most is None else r < F.lit(float(most)))
            weigh = F.when(free, 1.0).otherwise(bound) if most is None else F.when(F.col("clean"), 0.0).when(free, 1.0).otherwise(bound)
            asked += [F.sum(r * F.col("n") * F.col(f"p{i}")) for i in every]
            asked += [F.sum(weigh * F.col("n") * F.col(f"p{i}") * F.col(f"p{j}")) for i in every for j in every[i:]]
        row = members.withColumn("r", rate).withColumns({f"r{k}": step(F.col("r"), m) for k, m in enumerate(moves)}).agg(*asked).first()
        out = []
        for got in np.array([float(x or 0.0) for x in row]).reshape(len(moves), -1):
            gram = np.zeros((len(weights), len(weights)))
            gram[np.triu_indices(len(weights))] = got[len(weights) :]
            out.append((got[: len(weights)], np.maximum(gram, gram.T)))
        return out

    share = np.array(weights, float) / sum(weights)
    rate = bounded(F.lit(1.0 if most is None else float(most)))
    ((total, gram),) = sums(rate, [np.zeros(len(weights))], 1.0)  # all rates may start at the bound
    there = total
    budget = there.sum()

    def missed(total: np.ndarray) -> np.ndarray:
        return total - share * budget if most is None else total - caps(total, there, share)

    for _ in range(steps):
        off = missed(total)
        if not budget or np.abs(off).max() <= close * budget:
            break
        # the metric step, shorter and shorter, and last the plain gradient, whose step always helps unless this is the minimum
        some = np.arange(len(weights)) if most is None else np.flatnonzero(off)
        metric = np.zeros(len(weights))
        metric[some] = np.linalg.lstsq(gram[np.ix_(some, some)], off[some], rcond=1e-9)[0]
        moves = [*(metric / 2**k for k in range(10)), off / there.sum(), off / (4 * there.sum())]
        tried = ((m, *found) for i in range(0, len(moves), TRIES) for m, found in zip(moves[i : i + TRIES], sums(rate, moves[i : i + TRIES], 0.01)))
        better = next((x for x in tried if (missed(x[1]) ** 2).sum() < (off**2).sum() * (1 - 1e-6)), None)
        if better is None:
            break
        move, total, gram = better
        rate = step(rate, move)
    return rate


def caps(total: np.ndarray, there: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The most tokens of each domain for the first one's `total`: its share of all that is kept.

    A domain that has less there (`there`) than its share asks for, and the first, is left as it is in `total`.
    """
    out = total.astype(float)
    rest = [i for i in range(1, len(share))]
    rest.sort(key=lambda i: there[i] / share[i] if share[i] > 0 else np.inf)
    kept = total[0]
    while rest:
        whole = kept / max(1.0 - share[rest].sum(), 1e-12)  # tokens kept when all of `rest` are at their shares
        if there[rest[0]] >= share[rest[0]] * whole:
            out[rest] = share[rest] * whole
            break
        kept += total[rest.pop(0)]
    return out


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", most: float | None = None) -> DataFrame:
    """`id_col`, n_tokens, p_<domain> ..., rate, copies of every id of `docs`.

    `labels` has `id_col` and `domain`; rows without either, or of another domain, teach nothing. `copies` is
    the rate rounded up or down by a number in [0, 1) that is a hash of the id, so the expected copies are the
    rates. Rows of one id count as one document, rows without an id as one more. Documents without tokens have
    the domains' shares as posteriors and rate one at no cost. An empty table gives an empty result, and
    without labels all domains are alike. Other columns are not read.

    With `most`, the first of `weights` is the clean domain: documents labelled so, documents without a label
    that are likeliest to belong to it, and documents without tokens all have the rate `most`, and the other
    weights are upper shares of what is kept. However little there is of the others, no clean document goes.
    """
    domains = list(weights)
    known = labels.where(F.col(id_col).isNotNull() & F.col("domain").isin(*domains)).select(id_col, "domain").dropDuplicates([id_col])
    members = memberships(docs.select(id_col, text_col), known, domains, id_col, text_col)
    if most is not None:
        named = known.select(F.col(id_col).alias("id"), "domain")
        members = members.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "id", "left")
        likeliest = F.col("p0") >= F.greatest(*[f"p{i}" for i in range(len(domains))]) if len(domains) > 1 else F.lit(True)
        clean = F.when(F.col("n") == 0, True).when(F.col("domain").isNotNull(), F.col("domain") == domains[0]).otherwise(likeliest)
        members = members.withColumn("clean", clean).drop("domain")
    members = members.checkpoint()
    passed = members.coalesce(max(1, -(-members.count() // PASS_ROWS)))
    rate = fit_rates(passed, [weights[d] for d in domains], most)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col("id")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    out = members.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"), chance.alias("__c"))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col("__c")).cast("long")).drop("__c")


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the label table: toxic, else good or junk."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "junk")
    return labels.select("doc_id", domain.alias("domain"))


WEIGHTS = {"good": 0.90, "junk": 0.08, "toxic": 0.02}


@register("op4_mixing")
def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")), WEIGHTS)
