"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Frequent pre-tokens of the corpus are compiled into a minimal acyclic
automaton (shared prefixes and shared suffixes).  Every arc carries a number;
the numbers along a word's path add up to the word's index, which selects its
token ids.  The arrays live in one file that each Python worker memory-maps.
Pre-tokens outside the lexicon are merged exactly by rank.

Defined cases: a null text counts as empty (no tokens, empty decoded text);
texts are processed whole, however long; repeated rows give repeated results;
an empty table gives no rows; merges of equal rank go from the left, and words of equal
frequency enter the lexicon in alphabetical order; extra columns are ignored by
:func:`digest` and kept by :func:`encode`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, ship, table, text_bytes

#: The pre-tokenisation pattern of the byte-level tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here all Unicode tables agree; other texts are cut by the library itself.
SETTLED = "[^\x00-ԯ‐-‧€]"
#: A word enters the lexicon if it makes up this share of some task's words; at most 1/share words per task.
LEXICON_SHARE = 2e-5
#: Most words in the lexicon, which bounds the broadcast automaton to some MB.
LEXICON_WORDS = 50_000
#: Entries of a worker's memo before it is emptied.
MEMO = 200_000
NONE = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- the automaton ---------------------------------------------------------


def compile_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words.

    Returns (arc keys ``state * 256 + byte`` ascending, arc targets, arc numbers); bit 62 of a
    target marks a final state.  State 0 is the root.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, arcs, words below
    open_states: list[list] = [[False, []]]  # along the last word: final, [(byte, frozen target)]
    labels: list[int] = []

    def freeze(depth: int) -> int:
        final, arcs = open_states[depth]
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(frozen)
            frozen.append((final, tuple(arcs), final + sum(frozen[t][2] for _, t in arcs)))
        return register[key]

    def shrink(depth: int) -> None:
        while len(labels) > depth:
            target = freeze(len(labels))
            open_states.pop()
            open_states[-1][1].append((labels.pop(), target))

    last = None
    for word in words:
        if last is not None and word <= last:
            raise ValueError("words must be sorted and distinct")
        common = 0
        while last is not None and common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        shrink(common)
        for byte in word[common:]:
            labels.append(byte)
            open_states.append([False, []])
        open_states[-1][0] = True
        last = word
    shrink(0)
    root = freeze(0)
    number = {s: i for i, s in enumerate([root, *(i for i in range(len(frozen)) if i != root)])}
    keys, targets, numbers = [], [], []
    for state, (final, arcs, _) in enumerate(frozen):
        before = int(final)
        for byte, target in arcs:
            keys.append(number[state] * 256 + byte)
            targets.append(number[target] | (1 << 62 if frozen[target][0] else 0))
            numbers.append(before)
            before += frozen[target][2]
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return tuple(np.array(x, dtype=np.int64)[order] for x in (keys, targets, numbers))


class Lexicon:
    """Memory-mapped automaton plus the ids of each of its words."""

    NAMES = ("keys", "targets", "numbers", "starts", "ids")

    def __init__(self, blob: bytes):
        handle, path = tempfile.mkstemp(prefix="tidemark-lexicon-")
        try:
            os.write(handle, blob)
            self.map = mmap.mmap(handle, 0, access=mmap.ACCESS_READ)
        finally:
            os.close(handle)
            os.unlink(path)
        sizes = np.frombuffer(self.map, dtype=np.int64, count=len(self.NAMES))
        at = 8 * len(self.NAMES)
        for name, size in zip(self.NAMES, sizes.tolist(), strict=True):
            setattr(self, name, np.frombuffer(self.map, dtype=np.int64, count=size, offset=at))
            at += 8 * size

    @classmethod
    def pack(cls, words: dict[bytes, list[int]]) -> bytes:
        ordered = sorted(words)
        starts = np.cumsum([0, *(len(words[w]) for w in ordered)])
        ids = [i for w in ordered for i in words[w]]
        parts = [np.asarray(x, dtype=np.int64) for x in (*compile_automaton(ordered), starts, ids)]
        return b"".join([np.array([len(x) for x in parts], dtype=np.int64).tobytes(), *(x.tobytes() for x in parts)])

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word in the lexicon or -1; all words advance one byte per step."""
        n = len(words)
        found = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return found
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        live = np.flatnonzero(lengths)
        state, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        step = 0
        while len(live):
            key = state[live] * 256 + flat[offsets[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            target = self.targets[at]
            state[live] = target & ((1 << 62) - 1)
            total[live] += self.numbers[at]
            step += 1
            ended = lengths[live] == step
            final = ended & (target >> 62 == 1)
            found[live[final]] = total[live[final]]
            live = live[~ended]
        return found

    def ids_of(self, index: int) -> list[int]:
        return self.ids[self.starts[index] : self.starts[index + 1]].tolist()


# --- the tokenizer ---------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteBPE:
    """Encodes and decodes whole texts exactly as the tokenizers library does without special tokens added."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        raw = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token)}
        self.byte_id = [raw[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[left], vocab[right]] = r
            self.made.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces_of: dict[int, bytes] = {i: b for b, i in raw.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile(PATTERN).findall
        self.unsettled = regex.compile(SETTLED).search
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.path = path
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.memo: dict[str, bytes] = {}  # ids as native unsigned 32-bit integers

    @property
    def library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if self.unsettled(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut(text)

    def merge(self, word: bytes) -> list[int]:
        """Exact merges: always the pair of lowest rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i : i + 2] = (made[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked symbols, for words of any length."""
        n, rank = len(ids), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ids = list(ids)
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = self.made[best], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := rank.get((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[after[a]]))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Put words into the memo: through the automaton, else by merging."""
        raw = [w.encode() for w in words]
        found = self.lexicon.find(raw).tolist() if self.lexicon else [-1] * len(raw)
        for word, b, index in zip(words, raw, found, strict=True):
            self.memo[word] = array("I", self.lexicon.ids_of(index) if index >= 0 else self.merge(b)).tobytes()

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native unsigned 32-bit integers."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        cut = []  # of each text its parts: the id of an added token, or a list of words
        for text in texts:
            parts = self.split_special(text) if self.split_special else [text]
            cut.append([self.special[p] if p in self.special else self.words(p) for p in parts])
        new = {w for parts in cut for part in parts if type(part) is list for w in part if w not in memo}
        if new:
            self.learn(list(new))
        get = memo.__getitem__
        return [b"".join([b"".join(map(get, part)) if type(part) is list else array("I", [part]).tobytes() for part in parts]) for parts in cut]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [memoryview(x).cast("I").tolist() for x in self.encode_raw(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def _tokenizer(path: str, lexicon: bytes | None) -> ByteBPE:
    made = ByteBPE(path, lexicon)
    release()  # what the parsed file took
    return made


# --- the operator ----------------------------------------------------------


def frequent_words(docs: DataFrame, path: str | None = None, share: float = LEXICON_SHARE, most: int = LEXICON_WORDS) -> list[str]:
    """Pre-tokens of the frequent words: those that make up ``share`` of a task's words, counted over all texts.

    Words end at ASCII white space; each is then cut as it stands after a space.  The ``most`` most
    frequent words count, which bounds the lexicon.  It changes speed only, never a result.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    path = path or default_path()

    def count(batches):
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for i in range(0, len(batch), 512):
                for text in text_bytes(batch.column(0).slice(i, 512)):
                    words = text.split()
                    total += len(words)
                    counts.update(words)
                if len(counts) > 8 / share:  # a lossy count keeps what can still reach the share
                    counts = Counter({w: n for w, n in counts.items() if n >= 0.5 * share * total})
        kept = {w: n for w, n in counts.items() if n >= share * total and len(w) <= 64}
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in kept], pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])
        del counts, kept
        release()

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r[0] for r in rows.orderBy(F.desc("n"), "word").limit(most).collect()]
    bpe = _tokenizer(path, None)
    return sorted({p for w in words for p in (*bpe.words(" " + w), w) if len(bpe.words(p)) == 1})


def build_lexicon(docs: DataFrame, path: str | None = None, words: list[str] | None = None) -> bytes:
    path = path or default_path()
    bpe = _tokenizer(path, None)
    words = frequent_words(docs, path) if words is None else words
    return Lexicon.pack({w.encode(): bpe.merge(w.encode()) for w in words})


def encode(docs: DataFrame, path: str | None = None, lexicon: bytes | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids; a column of that name is replaced."""
    import pyarrow as pa

    ship(docs.sparkSession)
    path = path or default_path()
    blob = docs.sparkSession.sparkContext.broadcast(lexicon if lexicon is not None else build_lexicon(docs.select(F.col(text).alias("text")), path))
    base = docs.drop(out)
    at = base.columns.index(text)

    def run(batches):
        bpe = _tokenizer(path, blob.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = [x for i in range(0, len(texts), 256) for x in bpe.encode_batch(texts[i : i + 256])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(frame: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` with the decoded text of its column of ids (null: empty)."""
    import pyarrow as pa

    ship(frame.sparkSession)
    path = path or default_path()
    base = frame.drop(out)
    at = base.columns.index(ids)

    def run(batches):
        bpe = _tokenizer(path, None)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.StringType())]))


def digest(docs: DataFrame, path: str | None = None, lexicon: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, made in one pass without moving ids."""
    import pyarrow as pa

    ship(docs.sparkSession)
    path = path or default_path()
    blob = docs.sparkSession.sparkContext.broadcast(lexicon if lexicon is not None else build_lexicon(docs, path))

    def run(batches):
        bpe = _tokenizer(path, blob.value)
        names = [str(i) for i in range(max(bpe.pieces_of) + 1)]
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            rows: tuple[list, list, list] = ([], [], [])
            for start in range(0, len(texts), 256):
                for ids in bpe.encode_batch([t or "" for t in texts.slice(start, 256).to_pylist()]):
                    rows[0].append(len(ids))
                    rows[1].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    rows[2].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.memo.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
