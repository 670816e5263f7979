"""Language identification by bit-sliced Bloom filters over character n-grams.

Slot i of the filter is a bit mask with one bit for each language.  The masks
at an n-gram's slots, combined by AND, are the languages that hold the n-gram.
A language holds the n-grams (1 to 4 letters of a padded word) that make up at
least ``SHARE`` of its n-grams of that order, so it holds at most 1/SHARE of
each order whatever the size of the corpus.  Popcounts of a text are corrected
for the false positives that a language's fill causes.

Defined cases: a text that is null or has no letter gets ``und`` and score 0;
a text whose n-grams no language holds gets the most frequent language and
score 0; ties go to the language with more training n-grams, then by name;
repeated rows are predicted alike; without training rows all are ``und``; an
empty table gives no rows; texts are read whole, however long; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table

SHARE = 1e-4
ORDERS = (1, 2, 3, 4)
HASHES = 3
#: Slots of the filter for each n-gram it holds.
SPACE = 16
#: Distinct words that a task counts before it hands on their n-grams.
FLUSH = 300_000
MEMO = 300_000
RUNS = re.compile(r"[^\W\d_]+").findall


def letters(text: str) -> list[str]:
    """The runs of letters of a text; numerals such as superscripts and Roman ones are none."""
    runs = RUNS(text.lower())
    if runs and not "".join(runs).isalpha():
        runs = [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return runs


def ngram_hashes(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the 64-bit hashes of all n-grams of the padded words and the words they come from."""
    flat = np.frombuffer(("".join(f" {w} " for w in words)).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    out, rolled = [], np.full(len(flat), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for n in ORDERS:
        m = len(flat) - n + 1
        if m <= 0:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            continue
        rolled = (rolled[:m] ^ flat[n - 1 :]) * np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 :]
        if n == 1:
            inside = inside & (flat != 32)
        h = rolled[inside] * np.uint64(0x94D049BB133111EB)
        out.append(((h ^ (h >> np.uint64(31))) + np.uint64(n), owner[:m][inside]))
    return out


class Filter:
    """Bit-sliced Bloom filter; ``names`` are the languages in bit order."""

    def __init__(self, names: list[str], slots: np.ndarray, fill: np.ndarray):
        self.names, self.slots = names, slots  # slots: [size, planes] uint64
        self.wrong = fill**HASHES  # false-positive rate of each language
        self.memo: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    @classmethod
    def build(cls, held: dict[str, np.ndarray], weight: dict[str, int]) -> Filter:
        names = sorted(held, key=lambda n: (-weight[n], n))
        size = 1 << max(10, (SPACE * len(np.unique(np.concatenate([*held.values(), np.empty(0, np.uint64)]))) - 1).bit_length())
        slots = np.zeros((size, max(1, -(-len(names) // 64))), dtype=np.uint64)
        fill = np.zeros(len(names))
        for i, name in enumerate(names):
            at = np.unique(np.concatenate(cls.places(held[name], size)))
            slots[at, i // 64] |= np.uint64(1 << (i % 64))
            fill[i] = len(at) / size
        return cls(names, slots, fill)

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        first, second = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return [((first + np.uint64(i) * second) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram hash the mask of all languages that hold it, [n, planes]."""
        first, *rest = self.places(hashes, len(self.slots))
        masks = self.slots[first]
        for at in rest:
            masks &= self.slots[at]
        return masks

    def learn(self, words: list[str]) -> None:
        """Memoise n-gram count and popcount of each language for new words."""
        made = np.zeros((len(words), len(self.names) + 1))
        for hashes, owner in ngram_hashes(words):
            masks = self.languages(hashes)
            made[:, -1] += np.bincount(owner, minlength=len(words))
            for i in range(len(self.names)):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                made[:, i] += np.bincount(owner, weights=bit, minlength=len(words))
        start = len(self.memo)
        self.memo.update(zip(words, range(start, start + len(words)), strict=True))
        self.rows.append(made)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [letters(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.rows = {}, []
        new = list({w for words in cut for w in words if w not in self.memo})
        if new:
            self.learn(new)
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        out = []
        for words in cut:
            if not words or not self.names:
                out.append(("und", 0.0))
                continue
            total = self.rows[0][np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            hits = np.maximum(0.0, (total[:-1] - total[-1] * self.wrong) / (1 - self.wrong))
            best = int(np.argmax(hits))
            out.append((self.names[best], float(hits[best] / hits.sum()) if hits[best] > 0 else 0.0))
        return out


def train(docs: DataFrame, share: float = SHARE) -> Filter:
    """Filter from the ``text`` and ``lang`` of all rows whose lang is not null."""
    import pyarrow as pa

    def count(batches):
        counts: dict[str, Counter] = {}

        def flush():
            for lang, words in counts.items():
                weights = np.fromiter(words.values(), dtype=np.int64, count=len(words))
                for n, (hashes, owner) in zip(ORDERS, ngram_hashes(list(words)), strict=True):
                    kinds, at = np.unique(hashes, return_inverse=True)
                    sums = np.bincount(at, weights=weights[owner], minlength=len(kinds)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(np.full(len(kinds), n, np.int32)), pa.array(kinds.view(np.int64)), pa.array(sums)], ["lang", "size", "gram", "n"])
            counts.clear()

        for batch in batches:
            for i in range(0, len(batch), 512):
                for text, lang in zip(batch.column(0).slice(i, 512).to_pylist(), batch.column(1).slice(i, 512).to_pylist(), strict=True):
                    counts.setdefault(lang, Counter()).update(letters(text or ""))
                if sum(map(len, counts.values())) > FLUSH:
                    yield from flush()
        yield from flush()

    grams = docs.where("lang is not null").select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, size int, gram long, n long")
    grams = grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    both = F.sum("n").over(key_window("lang", "size"))
    kept = grams.withColumn("all", both).where(F.col("n") >= share * F.col("all")).select("lang", "gram", "n").collect()  # at most 4 / share rows a language
    held: dict[str, list[int]] = {}
    weight: Counter = Counter()
    for lang, gram, n in kept:
        held.setdefault(lang, []).append(gram)
        weight[lang] += n
    return Filter.build({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in held.items()}, weight)


def key_window(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred and score from the text alone."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.slots, model.wrong ** (1 / HASHES)))

    def run(batches):
        own = Filter(*shared.value)
        for batch in batches:
            found = []
            for i in range(0, len(batch), 512):
                found += own.predict(batch.column(1).slice(i, 512).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    found = predict(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
