"""Mixing domains to target weights, with DataFrame operations only.

A naive Bayes classifier over binned text statistics, learned from the table of
labels, gives each document a posterior over the domains ``clean``, ``low`` and
``toxic``.  Nonnegative document rates r then solve

    min |W (A r - 1)|^2,  A[k, d] = tokens_d * posterior_dk / target_k,

by projected gradients from r = 1: each round is one distributed sum of the K
domain totals; W whitens A, so few rounds suffice.  Gradients are taken for each token, so a document's rate depends on its
posteriors alone and is bounded by them.  A round's residual is K numbers, and a document's rate is a fold of the
rounds so far over its own K numbers, so no per-document state is kept or moved.

Defined cases: null and empty texts have 0 tokens and rate 1; repeated rows have
equal rates, and each counts towards the totals; domains without any posterior
mass keep their target unmet; without labels all posterior mass is ``clean``;
an empty table gives no rows; marking words of equal weight are taken in
alphabetical order; texts are read whole, however long; extra columns, whatever
their names, are kept by :func:`apply`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, checkpoint, table, without

DOMAINS = ("clean", "low", "toxic")
#: Target shares of the tokens.
WEIGHTS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}
#: Most labelled documents in the training sample.
SAMPLE = 6000
#: Words that mark a domain.
MARKS = 200
ROUNDS = 30
TOLERANCE = 1e-6
#: Posterior mass below this share of a domain's target counts as none.
NONE = 1e-6
#: Posteriors are softened by this power, as the statistics depend on each other.
SOFT = 0.7


def words_of(text: Column) -> Column:
    """Lower-case words of a text (none: an empty array)."""
    return F.filter(F.split(F.lower(text), f"{ASCII_SPACE}+"), lambda w: w != "")


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain); of several rows for one document the worst counts."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return one.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").otherwise("clean").alias("domain"))


def statistics(docs: DataFrame, marks: dict[str, list[str]], keep: list) -> DataFrame:
    """``keep`` with n_tokens and the bin of each statistic of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    rate = lambda kind: F.regexp_count(text, F.lit(kind)) / size
    base = docs.select(*keep, text.alias("text"), F.split(F.lower(text), f"{ASCII_SPACE}+").alias("w"))
    base = base.withColumn("kinds", F.array_distinct("w"))
    marked = sorted({w for found in marks.values() for w in found})
    if marked:
        base = base.withColumn("hit", F.array_intersect("kinds", F.array(*map(F.lit, marked))))
    pieces = F.greatest(F.size("w"), F.lit(1))
    blanks = (F.element_at("w", 1) == "").cast("int") + ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    level = lambda x, step, top: F.least(F.floor(x * step), F.lit(top)).cast("int")
    bins = {
        "symbols": level(F.sqrt(rate("[#*$%&|<>]")), 20, 9),
        "exclaims": level(F.sqrt(rate("!")), 20, 9),
        "capitals": level(F.sqrt(rate("[A-Z]")), 12, 9),
        "digits": level(F.sqrt(rate("[0-9]")), 15, 9),
        "distinct": level(F.size("kinds") / pieces, 10, 9),
        "length": level(F.log2(pieces.cast("double")), 1, 14),
    }
    for name, found in marks.items():
        if found:
            bins[f"marks_{name}"] = F.least(F.size(F.array_intersect("hit", F.array(*map(F.lit, found)))), F.lit(6))
    return base.select(*keep, (F.size("w") - blanks).cast("long").alias("n_tokens"), *[b.alias(f"b_{n}") for n, b in bins.items()])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[dict[str, list[str]], dict[str, dict[int, list[float]]], list[float]]:
    """(marking words, log P(bin | domain) for each statistic, log priors) from a sample of labelled documents."""
    named = domain_of(labels)
    sizes = {r[0]: r[1] for r in named.groupBy("domain").count().collect()}
    if not sizes:
        return {}, {}, [0.0, -30.0, -30.0]
    part = {d: int(min(1.0, most / len(DOMAINS) / n) * 2**31) for d, n in sizes.items()}
    drawn = F.lit(False)
    for d, cut in part.items():
        drawn = drawn | ((F.col("domain") == d) & (F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < cut))
    sample = checkpoint(docs.select("doc_id", "text").join(F.broadcast(named.where(drawn)), "doc_id").select("domain", "text"))  # about SAMPLE rows
    n = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    spread = sample.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    seen = spread.groupBy("word").pivot("domain", list(DOMAINS)).count().na.fill(0)
    marks = {}
    for d in DOMAINS[1:]:
        others = sum((F.col(o) for o in DOMAINS if o != d), F.lit(0))
        own, rest = n.get(d, 0), sum(v for o, v in n.items() if o != d)
        if not own or not rest:
            continue
        odds = F.log((F.col(d) + 0.5) / (own + 1)) - F.log((others + 0.5) / (rest + 1))
        top = seen.withColumn("odds", odds).where((F.col(d) >= 5) & (F.col("odds") > 1.5)).orderBy(F.desc(F.col("odds") * F.sqrt(F.col(d))), "word").limit(MARKS)
        marks[d] = [r.word for r in top.collect()]
    binned = statistics(sample, marks, ["domain"])
    names = [c for c in binned.columns if c.startswith("b_")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("bin")) for c in names]))
    tables: dict[str, dict[int, list[float]]] = {c: {} for c in names}
    for name, b, domain, count in binned.select("domain", pairs.alias("x")).groupBy("x.name", "x.bin", "domain").count().collect():
        tables[name].setdefault(b, [0.0] * len(DOMAINS))[DOMAINS.index(domain)] += count
    for per_bin in tables.values():
        for counts in per_bin.values():
            for i, d in enumerate(DOMAINS):
                counts[i] = math.log((counts[i] + 0.5) / (n.get(d, 0) + 0.5 * 16))
    total = sum(sizes.values())
    priors = [math.log(sizes[d] / total) if sizes.get(d) else -30.0 for d in DOMAINS]
    return marks, tables, priors


def posteriors(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` with n_tokens and the posterior p_<domain> of each domain."""
    marks, tables, priors = model
    binned = statistics(docs, marks, keep)
    logs = []
    for i in range(len(DOMAINS)):
        total: Column = F.lit(0.0)
        for name, per_bin in tables.items():
            known = {b: v[i] for b, v in per_bin.items()}
            cases = F.lit(0.0)
            if known:
                pairs = [x for b, v in sorted(known.items()) for x in (F.lit(b), F.lit(v))]
                cases = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0))
            total = total + cases
        logs.append((F.lit(priors[i]) + SOFT * total).alias(f"l{i}"))
    with_logs = binned.select(*keep, "n_tokens", *logs)
    top = F.greatest(*[F.col(f"l{i}") for i in range(len(DOMAINS))])
    powers = with_logs.select(*keep, "n_tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in range(len(DOMAINS))])
    total = sum((F.col(f"e{i}") for i in range(1, len(DOMAINS))), F.col("e0"))
    return powers.select(*keep, "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p_{d}") for i, d in enumerate(DOMAINS)])


def rate_after(steps: list[list[float]], unit: list[float], most: float | None = None) -> Column:
    """A document's rate after the given steps: each subtracts <step, posterior / target> and cuts at 0 (and at ``most``), from 1 on."""
    if not steps:
        return F.lit(1.0)
    a = [F.col(f"p_{d}") * u for d, u in zip(DOMAINS, unit, strict=True)]
    rounds = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    cut = (lambda x: F.least(F.lit(most), x)) if most is not None else (lambda x: x)
    move = lambda r, s: cut(F.greatest(F.lit(0.0), r - sum((a[i] * F.element_at(s, i + 1) for i in range(1, len(a))), a[0] * F.element_at(s, 1))))
    return F.aggregate(rounds, F.lit(1.0), move)


def fit(soft: DataFrame, weights: dict[str, float], anchor: str = "clean", rounds: int = ROUNDS, most: float | None = None, fixed: Column | None = None) -> tuple[list[list[float]], list[float], float]:
    """The rounds' steps, 1 / target of each domain, and the largest relative error that is left.

    The anchor domain's target is what it has.  Rates of ``fixed`` documents stay 1, others lie between 0 and ``most``.
    Steps go along each token's gradient, so documents of equal posteriors have equal rates however long they are.
    A round that does not bring the totals nearer is taken back and its step cut.  Rounds end when every domain's
    total is within ``TOLERANCE`` of its target, or no step brings it nearer.
    """
    masses = [F.sum(F.col("n_tokens") * F.col(f"p_{d}")) for d in DOMAINS]
    have = [float(x or 0.0) for x in soft.agg(*masses).collect()[0]]
    budget = have[DOMAINS.index(anchor)] / weights[anchor]
    if budget <= 0:
        return [], [0.0] * len(DOMAINS), 0.0
    target = [budget * weights[d] for d in DOMAINS]
    unit = [1.0 / t if h > NONE * t > 0 else 0.0 for t, h in zip(target, have, strict=True)]
    a = [F.col(f"p_{d}") * u for d, u in zip(DOMAINS, unit, strict=True)]
    k, n = len(DOMAINS), F.col("n_tokens")
    free = ~F.coalesce(fixed, F.lit(False)) if fixed is not None else F.lit(True)
    steps: list[list[float]] = []
    best: tuple | None = None  # value, steps, error
    metrics: list[np.ndarray] = []  # W, and the plain metric for where the active bounds make W's step a wrong one
    sizes, turn = [1.0, 1.0], 0
    for _ in range(rounds):
        r = F.when(free, rate_after(steps, unit, most)).otherwise(1.0)
        inside = (F.col("r") > 0) & (F.col("r") < most if most is not None else F.lit(True)) | (F.lit(not steps))
        moving = F.when(free & inside, n).otherwise(0.0)
        sums = [F.sum(n * F.col("r") * x) for x in a] + [F.sum(moving * a[i] * a[j]) for i in range(k) for j in range(k)]
        got = np.array([float(x or 0.0) for x in soft.withColumn("r", r).agg(*sums).collect()[0]])
        error = got[:k] - np.array([1.0 if u else 0.0 for u in unit])
        value = float((error * error).sum())
        if best is None or value < best[0]:
            moves = got[k:].reshape(k, k)
            top = np.linalg.eigvalsh(moves)[-1] if best is None else top
            metrics = [np.linalg.pinv(moves, rcond=1e-9), np.eye(k) / max(top, 1e-300)]
            best = (value, steps, error)
            sizes[turn] *= 2 if turn else 1
        else:
            sizes[turn] /= 4
            turn = 1 - turn
        if np.abs(best[2]).max() < TOLERANCE or max(sizes) < 1e-6:
            break
        steps = [*best[1], (sizes[turn] * metrics[turn] @ best[2]).tolist()]
    return best[1], unit, float(np.abs(best[2]).max())


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, keep: tuple | list = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, posteriors, rate and left_error (the largest relative error of a domain's total) of each row of ``docs``."""
    soft = checkpoint(posteriors(docs, train(docs, labels), list(keep)))
    steps, unit, left = fit(soft, weights or WEIGHTS)
    return soft.withColumn("rate", rate_after(steps, unit)).withColumn("left_error", F.lit(left))


def apply(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each kept with the probability of its rate by a hash of its id.

    Documents that belong to the anchor domain, ``clean``, rather than not are all kept: their rates are fixed at 1
    and the others, fitted between 0 and 1, make up for what these hold of the other domains.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    soft = checkpoint(posteriors(keyed, train(docs, labels), ["doc_id", "text_key"]))
    sure = F.col("p_clean") >= 0.5
    steps, unit, _ = fit(soft, weights or WEIGHTS, most=1.0, fixed=sure)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return without(docs, soft.where(~sure & (draw >= rate_after(steps, unit, 1.0))))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
