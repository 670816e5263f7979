"""Quality rules with risk-controlled thresholds.

Each rule is a score of a text; a rule with a cutoff rejects texts above it.  The
cutoffs of a stratum (language) are certified together: with probability 1 - ``ERROR``,
over all strata, the rules together reject at most ``RISK`` of the good documents of each.

The labelled texts (copies count once) are cut in two by a hash.  The first half gives a path of
``PATH`` steps from lenient to strict: step j lets every rule that rejects more of the bad documents than of the good
reject j / PATH of ``RISK`` of the good ones.  On the second half, which had no part in that, the exact
binomial tail of the good documents that a step rejects by any rule is the p-value of the hypothesis
"it rejects more than ``RISK``".  Steps are tested from lenient to strict until the first that fails
(fixed-sequence testing), and all strata share ``ERROR`` by Bonferroni; the last step that passed is used.

Defined cases: a null text has no words; empty texts fail the base rule;
repeated rows are judged alike; a null language is a stratum of its own; a text
labelled more than once, or whose copies are, counts as good only if no row calls it bad;
without labels, and in strata with too few to certify anything, only the base rule acts; an
empty table gives no rows; texts at a cutoff are kept; texts are read whole, however long;
extra columns, whatever their names, are kept by :func:`apply`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, release, table, text_bytes, without

#: Largest share of a stratum's good documents that the rules may reject together.
RISK = 0.01
#: Probability that any certified cutoff exceeds its risk.
ERROR = 0.05
#: Cutoffs of every rule are levels of a fixed grid.
LEVELS = 40
#: Steps from lenient to strict.
PATH = 12
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_chars_text", "n_pipe_words", "n_upper"]
SPACE = b" \t\n\r\x0b\x0c"
NOT_STARTS = bytes(range(0x80, 0xC0)) + SPACE
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words that occurs twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Some hash repeats: name the windows exactly, by doubling.
    _, names = np.unique(codes, return_inverse=True)
    if len(set(words)) != names.max() + 1:  # two words share a hash
        number: dict[bytes, int] = {}
        names = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    step = 1
    while step < window:
        m = len(names) - step
        _, names = np.unique(names[:m] * (names.max() + 1) + names[step:], return_inverse=True)
        step *= 2
    names = names[:n]
    repeated = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(repeated), 1)
    np.add.at(edge, np.flatnonzero(repeated) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """The counts BASE and EXTRA of one text."""
    words = raw.split()
    filled = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    return (
        len(words),
        len(raw.translate(None, NOT_STARTS)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeated_words(words),
        len(filled),
        len(raw),
        words.count(b"|"),
        len(raw) - len(raw.translate(None, UPPER)),
    )


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of each document with the counts of its whole text."""
    import pyarrow as pa

    names = BASE + EXTRA
    base = docs.select(*keep, "text")

    def run(batches):
        for batch in batches:
            rows = [measure(t) for i in range(0, len(batch), 512) for t in text_bytes(batch.column(len(keep)).slice(i, 512))]
            made = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *names])
        release()

    return base.mapInArrow(run, with_longs(base.select(*keep).schema, names))


def with_longs(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.LongType()) for n in names]])


def rules() -> dict[str, Column]:
    """Rule scores, larger is worse, all between 0 and 1."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    length = F.col("word_chars") / words
    return {
        "symbols_per_word": F.least(F.col("n_symbols") / words / 4, F.lit(1.0)),
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "word_length": F.least(F.abs(F.log(F.greatest(length, F.lit(0.1)) / 5.5)) / 2.5, F.lit(1.0)),
        "capitals": F.least(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0)),
        "few_words": F.least(20.0 / words, F.lit(1.0)),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, from exact terms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def most_rejections(n: int, risk: float, error: float) -> int:
    """The largest count of rejected good documents among ``n`` that certifies ``risk``; -1 if none does."""
    low, high = -1, max(0, int(n * risk))
    while low < high:
        mid = (low + high + 1) // 2
        if binomial_tail(mid, n, risk) <= error:
            low = mid
        else:
            high = mid - 1
    return low


def levels() -> dict[str, Column]:
    return {r: F.ceil(F.greatest(s, F.lit(0.0)) * LEVELS).cast("int") for r, s in rules().items()}


def steps(good: dict[str, np.ndarray], bad: dict[str, np.ndarray], risk: float) -> list[dict[str, int]]:
    """The path of a stratum: for each step the cutoff level of each rule in use, from its tallies of levels; cutoffs never rise."""
    out = []
    for j in range(1, PATH + 1):
        cuts = {}
        for rule in good:
            above = [tally.sum() - np.cumsum(tally) for tally in (good[rule], bad[rule])]  # rejected at each cutoff
            n = max(1, int(good[rule].sum())), max(1, int(bad[rule].sum()))
            cut = int(np.argmax(above[0] <= risk * j / PATH * n[0]))
            if above[1][cut] / n[1] > above[0][cut] / n[0]:
                cuts[rule] = min(cut, out[-1].get(rule, LEVELS) if out else LEVELS)
            elif out and rule in out[-1]:
                cuts[rule] = out[-1][rule]
        out.append(cuts)
    return out


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[tuple[str | None, str], int]:
    """Certified cutoff level for each (stratum, rule).

    ``measured`` has doc_id, stratum, text_key and the counts.  Only counts reach the driver, of strata with labels enough to
    certify something: for each at most rules * (LEVELS + 1) * 2 and then PATH + 1 rows.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.where(~F.col("base_failed")).join(rows, "doc_id").groupBy("stratum", "text_key").agg(F.min("quality").alias("quality"), *[F.any_value(r).alias(r) for r in rules()])
    known = checkpoint(known.withColumn("second", F.pmod(F.xxhash64(F.lit("half"), "text_key"), F.lit(2)) == 1))
    least = math.ceil(math.log(error) / math.log1p(-risk))  # with fewer, not even no rejection at all certifies the risk
    sizes = {r[0]: r[1] for r in known.where("second and quality = 1").groupBy("stratum").count().where(F.col("count") >= least).collect()}
    if not sizes:
        return {}
    known = known.where(F.coalesce(F.col("stratum").isin([s for s in sizes if s is not None]), F.lit(None in sizes)))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in rules()]))
    tally = {s: [{r: np.zeros(LEVELS + 1, dtype=np.int64) for r in rules()} for _ in range(2)] for s in sizes}
    for stratum, good, rule, level, n in known.where("not second").select("stratum", (F.col("quality") == 1).alias("good"), each.alias("x")).groupBy("stratum", "good", "x.rule", "x.level").count().collect():
        tally[stratum][0 if good else 1][rule][min(max(level, 0), LEVELS)] += n
    paths = {s: steps(*both, risk) for s, both in tally.items()}
    # the first step that rejects a text: the path is nested, so every later one does too
    first = F.lit(PATH)
    for stratum, path in paths.items():
        here = F.col("stratum").eqNullSafe(F.lit(stratum))
        found = F.lit(PATH)
        for j in range(PATH - 1, -1, -1):
            for rule, cut in path[j].items():
                found = F.when(F.col(rule) > cut, F.lit(j)).otherwise(found) if j == 0 or path[j - 1].get(rule) != cut else found
        first = F.when(here, found).otherwise(first)
    rejected = {s: np.zeros(PATH + 1, dtype=np.int64) for s in sizes}
    for stratum, j, n in known.where("second and quality = 1").select("stratum", first.alias("j")).groupBy("stratum", "j").count().collect():
        rejected[stratum][j] += n
    found = {}
    for stratum, n in sizes.items():
        allowed, passed = most_rejections(n, risk, error / len(sizes)), {}
        for j, k in enumerate(np.cumsum(rejected[stratum])[:PATH]):
            if k > allowed:
                break
            passed = paths[stratum][j]
        found |= {(stratum, rule): cut for rule, cut in passed.items() if cut < LEVELS}
    return found


def verdict(cutoffs: dict[tuple[str | None, str], int]) -> Column:
    """True unless a certified cutoff of the document's stratum is exceeded."""
    bad = F.lit(False)
    for (stratum, rule), cut in cutoffs.items():
        bad = bad | (F.col("stratum").eqNullSafe(F.lit(stratum)) & (F.col(rule) > cut))
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, text_key (a hash of the text), the stratum, the counts, base_failed and kept for each row of ``docs``."""
    keyed = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("text_key"), "text")
    measured = counts(keyed, ["doc_id", "stratum", "text_key"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = checkpoint(measured.withColumn("base_failed", failed).withColumns(levels()))
    return measured.withColumn("kept", ~F.col("base_failed") & verdict(certify(measured, labels, risk, error)))


def apply(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; repeated rows share their fate."""
    return without(docs, judge(docs, labels, stratum).where(~F.col("kept")))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")
