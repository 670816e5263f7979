"""Toxicity by a two-state linear-chain conditional random field.

Tokens of a bounded sample of labelled texts are labelled by distant
supervision: a token of a toxic text is toxic if its word, or a prefix of it,
occurs in significantly more toxic than clean texts, or if it stands among at most ``GAP`` other words between two
such tokens, so that spans count and not words alone.  The field learns a weight for each
such word, one for all other words and the transitions, by gradient ascent on
exact forward-backward marginals, single and pairwise.  A run of other words multiplies the forward
vector by a power of one 2x2 matrix, taken in closed form with its derivatives, so inference is
exact over whole texts at the cost of their marked words.  A text's score is a
logistic function, fitted on the same sample, of its marginals.

Defined cases: null and empty texts score as texts without a marked word;
repeated rows score alike; without labelled documents of both classes the score is
0; a text labelled twice is toxic if any row says so; an empty table gives no rows; words
whose evidence ties are taken in alphabetical order; texts are read whole, however long;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table, text_bytes

#: Most labelled texts in the sample, for each class.
SAMPLE = 8000
#: Most words with a weight of their own.
LEXICON = 2000
#: A word is marked if its toxic rate is above the clean one by so many standard errors.
SIGMAS = 4.0
THRESHOLD = 0.3
#: Most other words between two marked ones that are looked at one by one.
GAP = 2
STEPS = 150
MEMO = 400_000
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def normal_word(raw: bytes) -> str:
    return EDGES.sub("", raw.decode("utf-8", "replace").lower())


#: A word also counts by its first letters, so that inflected and compound forms share evidence.
PREFIXES = (6, 5, 4)


def units(word: str) -> list[str]:
    """The word itself and its prefixes, marked ``^``."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)] if word else []


class Marker(dict):
    """Raw word -> index of its marked unit, the word itself before its prefixes and long before short; or -1."""

    def __init__(self, lexicon: list[str]):
        super().__init__()
        self.index = {w: i for i, w in enumerate(lexicon)}

    def __missing__(self, raw: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        found = next((i for i in map(self.index.get, units(normal_word(raw))) if i is not None), -1)
        if len(raw) <= 64:
            self[raw] = found
        return found

    def chain(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions, words) of the marked words, and of others in short gaps between them, and the number of all words."""
        words = text.split()
        codes = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        at = np.flatnonzero(codes >= 0)
        for i in np.flatnonzero((np.diff(at) > 1) & (np.diff(at) <= GAP + 1)):
            codes[at[i] + 1 : at[i + 1]] = len(self.index)
        at = np.flatnonzero(codes >= 0)
        return at, codes[at], len(words)


class Field:
    """Parameters: ``word`` weights and ``other`` weight of state 1; ``move`` log weights of 0->0, 0->1, 1->0, 1->1.

    Word number len(word) is any other word.
    """

    def __init__(self, word: np.ndarray, other: float = -4.0, move=(0.0, -2.0, 0.0, -1.0)):
        self.word, self.other, self.move = np.asarray(word, dtype=float), float(other), np.asarray(move, dtype=float)

    def step(self) -> np.ndarray:
        """The step over an other word."""
        return np.exp(self.move.reshape(2, 2)) * np.array([1.0, np.exp(self.other)])

    def runs(self, lengths: np.ndarray, slopes: bool = False):
        """Powers of the step over an other word, [n, 2, 2], and their log scales; with ``slopes`` the powers' derivatives by other and the moves, [n, 5, 2, 2], at the same scale."""
        step = self.step()
        half, det = (step[0, 0] + step[1, 1]) / 2, step[0, 0] * step[1, 1] - step[0, 1] * step[1, 0]
        root = np.sqrt(max(half * half - det, 1e-300))
        high, low = half + root, half - root
        first = (step - low * np.eye(2)) / (high - low)
        second, n, share = np.eye(2) - first, lengths.astype(float), low / high
        ratio = share**n
        powers, scale = first + ratio[:, None, None] * second, lengths * np.log(high)
        if not slopes:
            return powers, scale
        # the sum over i of N^i D N^(n-1-i) with N = first + share * second
        g, last = (1 - ratio) / (1 - share), n * share ** np.maximum(n - 1, 0)
        d = np.zeros((5, 2, 2))
        d[0, :, 1] = step[:, 1]
        for k in range(4):
            d[1 + k, k // 2, k % 2] = step[k // 2, k % 2]
        d /= high
        terms = [(n, first @ d @ first), (g, first @ d @ second + second @ d @ first), (last, second @ d @ second)]
        return powers, scale, sum(c[:, None, None, None] * m for c, m in terms)

    def marginals(self, chains: list[tuple[np.ndarray, np.ndarray, int]], slopes: bool = False):
        """P(state 1) at each marked word, and log Z of each chain; with ``slopes`` also the derivatives of the sum of log Z by
        ``other`` within runs and by the moves: what the chains are expected to hold of each."""
        n = len(chains)
        counts = np.array([len(c[0]) for c in chains], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.concatenate([c[1] for c in chains]) if n else np.empty(0, np.int64)
        emit = np.exp(np.append(self.word, self.other)[flat]) if len(flat) else np.empty(0)
        gaps = np.concatenate([np.diff(c[0], prepend=-1) - 1 for c in chains]) if n else np.empty(0, np.int64)
        tails = np.array([c[2] - 1 - (c[0][-1] if len(c[0]) else -1) for c in chains], dtype=np.int64)
        power, scale, *power_slopes = self.runs(gaps, slopes)
        end, end_scale, *end_slopes = self.runs(tails, slopes)
        step = np.exp(self.move.reshape(2, 2))
        forward, expected = np.zeros((len(flat), 2)), np.zeros(5)
        carry, log_z = np.tile([1.0, 0.0], (n, 1)), np.zeros(n)
        longest = int(counts.max()) if n else 0
        order = np.argsort(-counts, kind="stable")
        for k in range(longest):
            live = order[: np.searchsorted(-counts[order], -k, side="left")]
            at = starts[live] + k
            v = np.einsum("ni,nij->nj", carry[live], power[at]) @ step
            v[:, 1] *= emit[at]
            total = v.sum(axis=1)
            carry[live] = forward[at] = v / total[:, None]
            log_z[live] += np.log(total) + scale[at]
        last = np.einsum("ni,nij->nj", carry, end).sum(axis=1)
        if slopes:
            expected += (np.einsum("ni,nkij->nk", carry, end_slopes[0]) / last[:, None]).sum(axis=0)
        before = np.zeros_like(forward)  # the forward vector before each marked word's run
        if len(flat):
            before[1:] = forward[:-1]
            before[starts[:-1][counts > 0]] = (1.0, 0.0)
        log_z += np.log(last) + end_scale
        back = end.sum(axis=2)
        result = np.zeros(len(flat))
        for k in range(longest - 1, -1, -1):
            live = order[: np.searchsorted(-counts[order], -k, side="left")]
            at = starts[live] + k
            joint = forward[at] * back[live]
            result[at] = joint[:, 1] / joint.sum(axis=1)
            v = back[live].copy()
            v[:, 1] *= emit[at]
            if slopes:
                at_run = np.einsum("ni,nij->nj", before[at], power[at])
                pairs = at_run[:, :, None] * step * v[:, None, :]
                whole = pairs.sum(axis=(1, 2))
                expected[1:] += (pairs / whole[:, None, None]).sum(axis=0).ravel()
                expected += (np.einsum("ni,nkij,nj->nk", before[at], power_slopes[0][at], v @ step.T) / whole[:, None]).sum(axis=0)
            v = np.einsum("nij,nj->ni", power[at], v @ step.T)
            back[live] = v / v.sum(axis=1)[:, None]
        found = np.split(result, starts[1:-1]) if n else []
        return (found, log_z, expected) if slopes else (found, log_z)

    def gradient(self, chains, truth: list[np.ndarray], moves: np.ndarray | None = None) -> np.ndarray:
        """Of the log likelihood of fully labelled chains (words that are not marked are 0), by the words, other and the moves; ``moves``, where given, are the chains' own."""
        words, gold = np.concatenate([c[1] for c in chains]), np.concatenate(truth).astype(float)
        size = len(self.word) + 1
        marginal, _, expected = self.marginals(chains, True)
        by_word = np.bincount(words, weights=gold, minlength=size) - np.bincount(words, weights=np.concatenate(marginal), minlength=size)
        return np.concatenate([by_word[:-1], [by_word[-1] - expected[0]], (self.moves(chains, truth) if moves is None else moves) - expected[1:]])

    @staticmethod
    def moves(chains, truth: list[np.ndarray]) -> np.ndarray:
        """How often the labelled chains go from state to state."""
        moves = np.zeros(4)
        for (at, _, n), y in zip(chains, truth, strict=True):
            pairs = 2 * np.r_[0, y][:-1] * np.r_[True, np.diff(at) == 1] + y if len(at) else np.empty(0)
            ones = y.astype(bool)
            after = np.r_[np.diff(at) > 1, n - 1 > at[-1]] if len(at) else np.empty(0, bool)
            moves += np.bincount(pairs.astype(int), minlength=4)
            moves[2] += (ones & after).sum()
            moves[0] += n - len(at) - (ones & after).sum()
        return moves

    def fit(self, chains, truth: list[np.ndarray], steps: int = STEPS) -> Field:
        """Adam on the penalised log likelihood."""
        words = np.concatenate([c[1] for c in chains])
        n_words, total = np.bincount(words, minlength=len(self.word) + 1), max(1, len(words))
        scale = np.concatenate([np.maximum(n_words[:-1], 1), [total], np.full(4, total)]).astype(float)
        moves = self.moves(chains, truth)
        m = v = np.zeros(len(self.word) + 5)
        for t in range(1, steps + 1):
            g = (self.gradient(chains, truth, moves) - 0.05 * np.concatenate([self.word, [self.other], self.move])) / scale
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            delta = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            self.word = self.word + delta[: len(self.word)]
            self.other = float(np.clip(self.other + delta[-5], -12, 0))
            self.move = np.clip(self.move + delta[-4:], -8, 8)
        return self


def features(marginal: np.ndarray, n: int) -> np.ndarray:
    """What a text's marginals come to: any toxic word, how many, and how dense."""
    any_toxic = 1 - np.exp(np.log1p(-np.minimum(marginal, 1 - 1e-9)).sum()) if len(marginal) else 0.0
    total = marginal.sum()
    return np.array([1.0, any_toxic, np.log1p(total), np.log1p(100 * total / max(n, 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps on the penalised log likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: list[str], field: Field, weights: np.ndarray | None):
        self.lexicon, self.field, self.weights = lexicon, field, weights
        self._marker: Marker | None = None

    def __getstate__(self):
        return self.__dict__ | {"_marker": None}

    @property
    def marker(self) -> Marker:
        if self._marker is None:
            self._marker = Marker(self.lexicon)
        return self._marker

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list]:
        """Scores, and for each text (positions of its marked words, marginals)."""
        chains = [self.marker.chain(t) for t in texts]
        if self.weights is None:
            return np.zeros(len(texts)), [(c[0], np.zeros(len(c[0]))) for c in chains]
        marginal, _ = self.field.marginals(chains)
        x = np.array([features(m, c[2]) for m, c in zip(marginal, chains, strict=True)]).reshape(len(texts), 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), [(c[0], m) for c, m in zip(chains, marginal, strict=True)]


def spread(found: list[tuple[str, int]]) -> list[str]:
    """Without prefixes that occur in hardly more toxic texts than one of the words or longer prefixes they begin."""
    best: dict[str, int] = {}
    for unit, n in found:
        for p in units(unit.lstrip("^")):
            if p.startswith("^") and p != unit:
                best[p] = max(best.get(p, 0), n)
    return [u for u, n in found if not u.startswith("^") or n > 1.3 * best.get(u, 0)]


def sample_labels(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most about ``most`` texts of each class, picked by hash: the whole class where it is smaller."""
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in clean.groupBy("toxic").count().collect() if r[0] in (0, 1)}
    keep = F.lit(False)
    for value, n in sizes.items():
        part = int(min(1.0, most / n) * 2**31)
        keep = keep | ((F.col("toxic") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < part))
    return clean.where(keep)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    import pyarrow as pa

    spark = docs.sparkSession
    sample = sample_labels(labels, most)
    ids = {r[0]: r[1] for r in sample.collect()}  # at most about 2 * SAMPLE rows
    if len(set(ids.values())) < 2:
        return Model([], Field(np.empty(0)), None)
    known = spark.sparkContext.broadcast(ids)
    wanted = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")

    def tally(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                counts[known.value[doc]].update({u for w in {normal_word(w) for w in set(text.split())} for u in units(w)})
        words = [w for w in counts[0].keys() | counts[1].keys() if len(w) <= 64]
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array([counts[1][w] for w in words], pa.int64()), "clean": pa.array([counts[0][w] for w in words], pa.int64())})

    n1 = sum(ids.values())
    n0 = len(ids) - n1
    tallied = wanted.mapInArrow(tally, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    rate, clean = F.col("t") / n1, (F.col("c") + 0.5) / (n0 + 1)
    z = (rate - clean) / F.sqrt(clean * (1 - clean) / n1 + rate * (1 - rate) / n1)
    rows = tallied.where("t >= 3").withColumn("z", z).where(F.col("z").isNull() | (F.col("z") >= SIGMAS)).where(rate > 3 * clean).orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    lexicon = spread([(r.word, r.t) for r in rows])
    first = Model(lexicon, Field(np.zeros(len(lexicon))), None)
    shared = spark.sparkContext.broadcast(first)

    def chains_of(batches):
        for batch in batches:
            found = [shared.value.marker.chain(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in found], pa.list_(pa.int64())), pa.array([c[1] for c in found], pa.list_(pa.int64())), pa.array([c[2] for c in found], pa.int64())], ["doc_id", "at", "word", "n"])

    got = wanted.mapInArrow(chains_of, "doc_id long, at array<long>, word array<long>, n long").orderBy("doc_id").collect()  # marked words of the sample only
    chains = [(np.array(r.at, dtype=np.int64), np.array(r.word, dtype=np.int64), r.n) for r in got]
    y = np.array([ids[r.doc_id] for r in got])
    if len(set(y.tolist())) < 2:
        return Model([], Field(np.empty(0)), None)
    truth = [np.full(len(c[0]), float(t)) for c, t in zip(chains, y, strict=True)]
    field = Field(np.zeros(len(lexicon)))
    if lexicon and any(len(c[0]) for c in chains):
        some = [i for i, c in enumerate(chains) if len(c[0])]
        field.fit([chains[i] for i in some], [truth[i] for i in some])
    marginal, _ = field.marginals(chains)
    x = np.array([features(m, c[2]) for m, c in zip(marginal, chains, strict=True)])
    share = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).collect()[0][0]
    weights = fit_logistic(x, y)
    # The sample holds the classes in other shares than the labels do.
    weights[0] += np.log(share / (1 - share)) - np.log(n1 / n0) if 0 < share < 1 else 0.0
    return Model(lexicon, field, weights)


def tag(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, score and the character spans [start, end) of words whose marginal is at least ``least``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            for i in range(0, len(batch), 2048):
                texts = text_bytes(batch.column(1).slice(i, 2048))
                scores, marked = own.score(texts)
                spans = []
                for text, (at, marginal) in zip(texts, marked, strict=True):
                    wanted = {int(a): float(p) for a, p in zip(at, marginal, strict=True) if p >= least}
                    found = []
                    if wanted:
                        for k, w in enumerate(re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text)):
                            if k in wanted:
                                start = len(text[: w.start()].decode("utf-8", "replace"))
                                found.append({"start": start, "end": start + len(w[0].decode("utf-8", "replace")), "marginal": wanted[k]})
                    spans.append(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 2048), pa.array(scores), pa.array(spans, spans_type)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start: int, end: int, marginal: double>>")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = tag(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
