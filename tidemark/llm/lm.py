"""Language-model scores by a weighted backoff automaton.

Words and n-grams are counted over the whole training part.  Word
probabilities are discounted by Good and Turing's D = n1 / (n1 + 2 n2), whose
mass D * V / N is that of one symbol for all unknown words.  Every word pair
and triple that occurs ``LEAST`` times or more, at any size of the corpus, gets
a discounted probability, interpolated with that of the shorter history.
Histories are the states of an automaton.  An arc leads to the state of the
longest history that is kept; a failure arc drops the oldest word and costs
the backoff weight that makes the state's probabilities add up to one.

Words and n-grams grow with the corpus, so they are never sent whole to a task
or to the driver: each task's documents make up blocks of bounded size, and each
block gets the counts, arcs and failure arcs of its own words and n-grams
by joins on their hashes.  Words have 64-bit hashes, so their counts are exact.
Those of n-grams are as long as the corpus needs: the bits that number all its
characters and ``SPARE`` more, at most 63; about one n-gram in 2**SPARE shares
one and is counted with another, and counts as far as its ends are kept.

Defined cases: null and empty texts hold the end token alone; words that only
held-out texts have are unknown; without training tokens every score uses
V = N = 0; repeated rows are scored as often as they occur; null ids are
training rows; an empty table gives no rows; texts are read whole, and one longer than
a block is a block of its own; scores need no rule for ties; extra columns are ignored.
"""

from __future__ import annotations

import gc
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, run_folder, table, text_bytes

#: Least occurrences of a kept word pair or triple.
LEAST = 2
#: Absolute discount of pairs and triples.
DISCOUNT = 0.75
#: Characters of text in a block.
BLOCK_CHARS = 12_000_000
#: Bits of an n-gram's hash beyond those that number all characters.
SPARE = 16
END = b"\n"  # no word holds white space
START = b" "


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Stable 64-bit hashes."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


#: A block: ids, held-out flags and token counts of its texts, its tokens' numbers and the hashes of its distinct words.
ENCODED = "block long, doc_ids array<long>, held binary, lens binary, ids binary, words binary"


def encode(batches):
    """Blocks of ``BLOCK_CHARS`` or a little more of a task's rows (doc_id, text, held_out)."""
    import pyarrow as pa
    from pyspark import TaskContext

    n = 0
    number: dict[bytes, int] = {}
    parts: tuple[list, list, list] = ([], [], [])
    size = 0

    def made():
        nonlocal n
        blobs = [pack(np.concatenate(x).astype(np.int64)) for x in (parts[1], [[len(i) for i in parts[2]]], parts[2])]
        block = (TaskContext.get().partitionId() << 32) + n
        n += 1
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([parts[0]], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in (*blobs, pack(word_hashes(list(number))))]], ["block", "doc_ids", "held", "lens", "ids", "words"])

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            texts = text_bytes(part.column(1))
            parts[0].extend(part.column(0).to_pylist())
            parts[1].append(np.array(part.column(2).to_pylist()))
            parts[2].extend(np.array([number.setdefault(w, len(number)) for w in tokens(text)], dtype=np.int32) for text in texts)
            size += sum(map(len, texts)) + len(texts)
            if size >= BLOCK_CHARS:
                yield made()
                number.clear()
                for x in parts:
                    x.clear()
                size = 0
    if parts[0]:
        yield made()


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written and read again, so that its shuffle files can go."""
    spark = df.sparkSession
    path = run_folder(spark, kind)
    df.write.parquet(path)
    del df
    for _ in range(2):  # Spark deletes shuffle files when the driver's Python and JVM have dropped their plans
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return spark.read.schema(ENCODED if kind == "lm-encoded" else RETURNED).parquet(path)


def start_hash() -> np.uint64:
    return word_hashes([START]).view(np.uint64)[0]


class Encoded:
    """The texts of a block, end to end: word numbers, and a hash of the word, pair and triple that ends at each token."""

    def __init__(self, row: dict, shift: int):
        self.block, self.doc_ids = row["block"], row["doc_ids"]
        self.held = unpack(row["held"]).astype(bool)
        self.lens, self.ids = unpack(row["lens"]), unpack(row["ids"]).astype(np.int32)
        self.words = unpack(row["words"], np.uint64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.training = np.repeat(~self.held, self.lens)
        here = self.words[self.ids]
        before = np.concatenate([[np.uint64(0)], here[:-1]])
        before[self.starts] = start_hash()
        self.pair = mixed(before, here)
        self.triple = mixed(np.concatenate([[np.uint64(0)], self.pair[:-1]]), here)
        for x in (self.pair, self.triple):
            np.left_shift(np.right_shift(x, np.uint64(shift), out=x), np.uint64(shift), out=x)
        self.inner = np.ones(len(self.ids), dtype=bool)
        self.inner[self.starts] = False  # the first token ends a pair with the start, but no triple

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of pairs and triples, ascending, and their training counts; a lowest bit marks training tokens meanwhile."""
        every = np.concatenate([self.pair | self.training, self.triple[self.inner] | self.training[self.inner]])
        every.sort()
        keys = every & ~np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        return keys[first], np.add.reduceat((every & np.uint64(1)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, ascending, and their training counts."""
        order = np.argsort(self.words)
        return self.words[order], np.bincount(self.ids[self.training], minlength=len(self.words))[order]


def pack(x: np.ndarray) -> bytes:
    """64-bit integers, byte by byte of all, compressed."""
    import pyarrow as pa

    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def unpack(blob: bytes, dtype=np.int64) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    raw = pa.Codec("zstd").decompress(blob[8:], decompressed_size=8 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(dtype).reshape(n)


def pack_keys(keys: np.ndarray, shift: int) -> bytes:
    return pack(np.diff(keys >> np.uint64(shift), prepend=np.uint64(0)))


def unpack_keys(blob: bytes, shift: int) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64) << np.uint64(shift)


#: Rows of one range of hashes of a block: part i for those of n-grams, -1 - i for those of words.
PACKED = "part int, block long, keys binary, x binary, y binary"
RETURNED = "part int, block long, x binary, y binary"


def parted(block: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray, parts: int, shift: int):
    """Rows of ``PACKED``: ascending ``keys`` (of words without a shift) with two numbers each, cut into ranges of the hash."""
    import pyarrow as pa

    cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    at = [(i, slice(cut[i], cut[i + 1])) for i in range(parts) if cut[i] < cut[i + 1]]
    columns = [pa.array([i if shift else -1 - i for i, _ in at], pa.int32()), pa.array([block] * len(at), pa.int64()), pa.array([pack_keys(keys[s], shift) for _, s in at], pa.binary()), *[pa.array([pack(v[s]) for _, s in at], pa.binary()) for v in (x, y)]]
    return pa.Table.from_arrays(columns, ["part", "block", "keys", "x", "y"])


def summed(rows: DataFrame, shift: int, counts: bool) -> DataFrame:
    """Both numbers summed by key over all blocks, sent back to every block that has the key, in the order of the keys it sent.

    For ``counts`` only ``x`` is summed; what is sent back is 0 and 0 for keys whose sum does not reach ``LEAST`` (of words: 1);
    for others ``y`` is 1 in one of the blocks that have the key and 0 in the rest, plus 2 for words.
    """
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        words = group.column("part")[0].as_py() < 0
        keys = [unpack_keys(k, 0 if words else shift) for k in group.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        del keys

        def total(name: str) -> np.ndarray:
            sums = np.add.reduceat(np.concatenate([unpack(v) for v in group.column(name).to_pylist()])[order], starts)
            out = np.empty(len(order), dtype=np.int64)
            out[order] = np.repeat(sums, sizes)
            return out

        x = total("x")
        if counts:
            y = np.full(len(order), 2 * words)
            y[order[starts]] += 1
            gone = x < (1 if words else LEAST)
            x[gone] = y[gone] = 0
        else:
            y = total("y")
        out = [[pack(v[end - n : end]) for end, n in zip(ends, np.diff(ends, prepend=0))] for v in (x, y)]
        return pa.Table.from_arrays([group.column("part"), group.column("block"), *[pa.array(o, pa.binary()) for o in out]], ["part", "block", "x", "y"])

    return rows.groupBy("part").applyInArrow(run, RETURNED)


def totals(counted: DataFrame) -> tuple[int, int, int, int]:
    """Training tokens, vocabulary, words that occur once and twice."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            c = np.concatenate([np.empty(0, np.int64), *[unpack(x)[unpack(y) == 3] for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]])
            yield pa.RecordBatch.from_pydict({"a": [int(c.sum())], "b": [len(c)], "c": [int((c == 1).sum())], "d": [int((c == 2).sum())]})

    return tuple(x or 0 for x in counted.select("x", "y").mapInArrow(run, "a long, b long, c long, d long").agg(*[F.sum(k) for k in "abcd"]).collect()[0])


def unpacked(rows) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(x, y) of a block's rows of ``RETURNED``, in the order of its n-grams and of its words."""
    parts = sorted(zip(*[rows.column(c).to_pylist() for c in ("part", "x", "y")], strict=True))
    grams, words = [p for p in parts if p[0] >= 0], [p for p in reversed(parts) if p[0] < 0]
    return tuple(tuple(np.concatenate([np.empty(0, np.int64), *[unpack(p[i]) for p in kind]]) for i in (1, 2)) for kind in (grams, words))


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in ascending ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def found(keys: np.ndarray, grams: np.ndarray, where: np.ndarray):
    """Of the grams that end at the tokens ``where``: distinct ones that ``keys`` has, a token of each, their places in ``keys``, and the number of its gram for each token, or -1."""
    here = grams[where]
    order = np.argsort(here)
    ordered = here[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
    kinds = ordered[first]
    at = place(keys, kinds)
    kept = at >= 0
    number = np.where(kept, np.cumsum(kept) - 1, -1)
    of = np.full(len(grams), -1)
    if len(kinds):
        of[where[order]] = number[np.cumsum(first) - 1]
    return kinds[kept], where[order[first]][kept], at[kept], of


class Automaton:
    """Histories as states; 0 is the empty one.

    An arc's weight is the interpolated probability (n - D) / c(h) + gamma(h) P(w | shorter history), a failure
    arc's is gamma(h) = 1 - sum of (n - D) / c(h) over all words kept after h in the whole corpus.
    """

    def __init__(self, words: list[bytes], counts: list[int], grams: dict[tuple[int, ...], int], total: int, n_docs: int, vocabulary: int, ones: int, twos: int):
        """The model of a whole corpus.  grams: kept pairs and triples with their counts, -1 for the start of a text; both ends of a kept triple must be kept."""
        pairs = sorted(g for g in grams if len(g) == 2)
        number = {g: i for i, g in enumerate(pairs)}
        triples = sorted(g for g in grams if len(g) == 3)
        sums = np.zeros((2, 1 + len(words) + len(pairs)), dtype=np.int64)
        for g, n in grams.items():
            sums[:, g[0] + 1 if len(g) == 2 else 1 + len(words) + number[g[:2]]] += (n, 1)
        as_pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        as_triples = np.array([(number[g[:2]], number[g[1:]]) for g in triples], dtype=np.int64).reshape(-1, 2)
        self.build(np.array(counts), total, n_docs, vocabulary, ones, twos, as_pairs, np.array([grams[g] for g in pairs]), as_triples, np.array([grams[g] for g in triples]), sums)

    @classmethod
    def of(cls, *arrays) -> Automaton:
        auto = cls.__new__(cls)
        auto.build(*arrays)
        return auto

    def build(self, counts, total, n_docs, vocabulary, ones, twos, pairs, n_pairs, triples, n_triples, sums):
        """The part of the model that a block needs.

        pairs: word numbers, -1 for the start; triples: numbers of the pairs at both ends; sums: total count and number
        of the kept words after the start, each word and each pair.
        """
        d = ones / (ones + 2 * twos) if ones else 0.5
        d = min(max(d, 0.05), 0.95)
        self.discount, self.unknown = d, d * max(vocabulary, 1) / total if total else 1.0
        self.n_words = v = len(counts)
        single = np.maximum(counts - d, 1e-12) / max(total, 1)
        context = np.concatenate([[n_docs], counts, n_pairs]).astype(float)
        gamma = np.maximum(1 - (sums[0] - DISCOUNT * sums[1]) / np.maximum(context, 1), 1e-9)
        state = np.where(sums[1] > 0, np.cumsum(sums[1] > 0), 0)
        self.after, self.after_pair, self.start = state[1 : 1 + v], state[1 + v :], int(state[0])
        longest = np.where(self.after_pair > 0, self.after_pair, self.after[pairs[:, 1]])
        self.next_of_pair = longest
        is_state = state > 0
        self.backoff = np.concatenate([[0.0], np.log10(gamma[is_state])])
        self.fail = np.concatenate([[0], np.zeros(1 + v, dtype=np.int64), self.after[pairs[:, 1]]]).astype(np.int64)[np.concatenate([[True], is_state])]
        p_pair = (n_pairs - DISCOUNT) / context[pairs[:, 0] + 1] + gamma[pairs[:, 0] + 1] * single[pairs[:, 1]]
        p_triple = (n_triples - DISCOUNT) / np.maximum(n_pairs[triples[:, 0]], 1) + gamma[1 + v + triples[:, 0]] * p_pair[triples[:, 1]]
        keys = np.concatenate([state[pairs[:, 0] + 1] * v + pairs[:, 1], self.after_pair[triples[:, 0]] * v + pairs[triples[:, 1], 1]])
        order = np.argsort(keys)
        self.arcs, self.weights = keys[order], np.log10(np.concatenate([p_pair, p_triple]))[order]
        self.arc_number = np.full(len(keys) + 1, -1)
        self.arc_number[order] = np.arange(len(keys))
        self.n_pairs = len(pairs)

    def arc_of_pair(self, pair: np.ndarray) -> np.ndarray:
        return self.arc_number[pair]

    def arc_of_triple(self, triple: np.ndarray) -> np.ndarray:
        return self.arc_number[np.where(triple >= 0, self.n_pairs + triple, -1)]

    def weigh(self, states: np.ndarray, codes: np.ndarray, single: np.ndarray, arcs: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each word (below 0: of no arc) in a state, over failure arcs; single: its own log10 probability.

        ``arcs``, where given, has the arc of each word's longest kept gram, or -1: the first arc that failure arcs come to.
        """
        out, open_, s = np.zeros(len(codes)), np.arange(len(codes)), np.asarray(states)
        while len(open_):
            root = s == 0
            out[open_[root]] += single[open_[root]]
            open_, s = open_[~root], s[~root]
            wanted = s * self.n_words + codes[open_]
            if arcs is None:
                at = place(self.arcs, wanted)
            else:
                at = arcs[open_]
                at = np.where((at >= 0) & (np.append(self.arcs, -1)[at] == wanted), at, -1)
            hit = (at >= 0) & (codes[open_] >= 0)
            out[open_[hit]] += self.weights[at[hit]]
            open_, s = open_[~hit], s[~hit]
            out[open_] += self.backoff[s]
            s = self.fail[s]
        return out

    def score(self, codes: list[int], single: list[float]) -> float:
        """One word from ``start``."""
        return float(self.weigh(np.array([self.start] * len(codes)), np.array(codes), np.array(single)).sum())


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores of all rows of ``docs`` under the model of those where ``held_out`` is false."""
    import pyarrow as pa
    import pyarrow.compute as pc

    own = docs.select("doc_id", "text", held_out.alias("held_out"))
    n_docs = own.where(~F.col("held_out")).count()
    chars = own.agg(F.sum(F.length("text") + 1)).collect()[0][0] or 1
    n_blocks = -(-chars // BLOCK_CHARS)
    parts = n_blocks
    # n-grams are told apart by so many bits of their hash that one in 2**SPARE or fewer meets another
    shift = max(1, 64 - (chars.bit_length() + SPARE))
    encoded = written(own.mapInArrow(encode, ENCODED), "lm-encoded")

    def emit(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                e = Encoded(batch.slice(i, 1).to_pylist()[0], shift)
                for s, (keys, n) in ((shift, e.grams()), (0, e.counts())):
                    yield from parted(e.block, keys, n, np.zeros(len(keys), np.int64), parts, s).to_batches()

    def block_of(group: pa.Table):
        """(encoded block, counts of its words, kept keys, counts, marks) of a group of ``both``, and what is :func:`found` of its pairs and triples."""
        e = Encoded(group.filter(pc.is_valid(group.column("ids"))).to_pylist()[0], shift)
        ((n, mark), (n_words, mark_words)), (keys, _) = unpacked(group.filter(pc.is_valid(group.column("part")))), e.grams()
        keys, n, mark = (v[n > 0] for v in (keys, n, mark))
        count = np.empty(len(e.words), np.int64)
        count[np.argsort(e.words)] = n_words
        pairs, (kinds, at, places, of) = found(keys, e.pair, np.arange(len(e.ids))), found(keys, e.triple, np.flatnonzero(e.inner))
        whole = (pairs[3][at - 1] >= 0) & (pairs[3][at] >= 0)  # but for triples that meet another n-gram's hash both ends are kept
        of = np.where(np.append(whole, False)[of], np.append(np.cumsum(whole) - 1, -1)[of], -1)
        return e, count, n, mark, pairs, (kinds[whole], at[whole], places[whole], of)

    def heads_of(e: Encoded, pair: np.ndarray):
        """Hashes of the words and the start, and of the kept pairs; both ascending."""
        return np.unique(np.concatenate([[start_hash()], e.words])), pair

    def histories(group: pa.Table) -> pa.Table:
        """Of each history in the block: count and number of the kept words after it, of the grams that are this block's to sum."""
        e, _, n, mark, (pair, pair_at, at, pair_of), (_, triple_at, at3, _) = block_of(group)
        words, _ = heads_of(e, pair)
        before = np.where(e.inner[pair_at], e.words[e.ids[pair_at - 1]], start_hash())
        out = []
        for keys, to, of, s in ((words, np.searchsorted(words, before), at, 0), (pair, pair_of[triple_at - 1], at3, shift)):
            sums = [np.bincount(to, v, len(keys)).astype(np.int64) for v in ((mark[of] & 1) * n[of], mark[of] & 1)]
            out.append(parted(e.block, keys, *sums, parts, s))
        return pa.concat_tables(out)

    def run(group: pa.Table, head_table: pa.Table) -> pa.Table:
        e, count, n, _, (pair, pair_at, at, pair_of), (_, triple_at, at3, triple_of) = block_of(group)
        pairs = np.stack([np.where(e.inner[pair_at], e.ids[pair_at - 1], -1), e.ids[pair_at]], 1).astype(np.int64)
        triples = np.stack([pair_of[triple_at - 1], pair_of[triple_at]], 1)
        of_pairs, of_words = unpacked(head_table)
        head = np.searchsorted(heads_of(e, pair)[0], np.concatenate([[start_hash()], e.words]))
        sum_n, sum_k = (np.concatenate([w[head], p]) for w, p in zip(of_words, of_pairs, strict=True))
        auto = Automaton.of(count, total, n_docs, vocabulary, ones, twos, pairs, n[at], triples, n[at3], np.stack([sum_n, sum_k]))
        base = np.log10((count + 1) / (total + vocabulary + 1))
        single = np.log10(np.where(count > 0, np.maximum(count - auto.discount, 1e-12) / max(total, 1), auto.unknown))
        after = np.where(pair_of >= 0, np.append(auto.next_of_pair, 0)[pair_of], auto.after[e.ids])
        states = np.concatenate([[0], after[:-1]])
        states[e.starts] = auto.start
        own_score = auto.weigh(states, e.ids.astype(np.int64), single[e.ids], np.where(triple_of >= 0, auto.arc_of_triple(triple_of), auto.arc_of_pair(pair_of)))
        known, base_score, full = (np.add.reduceat(v, e.starts) for v in ((count[e.ids] > 0).astype(np.int64), base[e.ids], own_score))
        return pa.table({"doc_id": pa.array(e.doc_ids, pa.int64()), "held_out": pa.array(e.held), "n_tokens": pa.array(e.lens), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([total] * len(known), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(full, pa.float64())})

    counted = written(summed(encoded.mapInArrow(emit, PACKED), shift, True), "lm-counted")
    total, vocabulary, ones, twos = totals(counted)
    both = encoded.unionByName(counted, allowMissingColumns=True).repartition(n_blocks, "block")  # one exchange, read twice
    heads = summed(both.groupBy("block").applyInArrow(histories, PACKED), shift, False)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.groupBy("block").cogroup(heads.groupBy("block")).applyInArrow(run, schema)


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
