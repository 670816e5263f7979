"""Token ids in fixed-width bit-packed files.

Layout of a file: the magic ``TIDEBITS``, then little-endian unsigned 32-bit
``width`` and ``block`` (ids per block) and 64-bit ``n_ids``, ``n_docs`` and
``n_null`` (null document ids, which come first and are stored as 0);
``n_docs`` document ids (int64); ``n_docs + 1`` id offsets (int64); one byte
offset per block (int64); the blocks.  A block holds up to ``block`` ids of
``width`` bits each, least significant bit first, and starts at a byte.  Any
id is therefore found by arithmetic alone, and a block is unpacked by numpy.

Defined cases: a null text counts as empty (only the end id); null doc_ids
come first; repeated rows are written as often as they occur, rows of one
doc_id in any order; an empty table writes no file and gives no rows; texts are
encoded whole, however long; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from itertools import compress, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import run_folder, table

MAGIC = b"TIDEBITS"
HEAD = struct.Struct("<8sIIQQQ")
#: Ids in a block.
BLOCK = 4096
#: Entries of a worker's word memo before it is emptied.
MEMO = 400_000
#: Longer words are encoded each time, so that the memo stays small.
LONG = 64
#: Ids that a worker's memo holds before it is emptied.
IDS = 4_000_000
#: Bytes of text that are encoded at once, and ids in a file.
CHUNK = 6_000_000
FILE_IDS = 32_000_000
#: Bits of the merge table's slots.
SLOTS = 20
#: Of each ASCII byte: 0 letter, 1 digit, 2 other; and its lower case.
KINDS = np.array([0 if chr(b).isalpha() else 1 if chr(b).isdigit() else 2 for b in range(128)] + [0] * 128, dtype=np.int8)
LOWER = np.array([*bytes(range(128)).lower(), *range(128, 256)], dtype=np.uint8)
#: Above every merge rank.
RANKLESS = 1 << 30


def width_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits of each id, least significant first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, dtype="<u2", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_file(stream, doc_ids, lengths, ids: np.ndarray, width: int, block: int = BLOCK, n_null: int = 0) -> None:
    doc_ids, lengths = np.asarray(doc_ids, dtype="<i8"), np.asarray(lengths, dtype=np.int64)
    blocks = [pack(ids[i : i + block], width) for i in range(0, len(ids), block)]
    stream.write(HEAD.pack(MAGIC, width, block, len(ids), len(doc_ids), n_null))
    stream.write(doc_ids.tobytes())
    stream.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes())
    stream.write(np.cumsum([0, *(len(b) for b in blocks)])[: len(blocks)].astype("<i8").tobytes())
    for b in blocks:
        stream.write(b)


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.width, self.block, self.n_ids, self.n_docs, self.n_null = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a bit-packed token file")
        at = HEAD.size
        n_blocks = -(-self.n_ids // self.block)
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        self.offsets = np.frombuffer(self.data, "<i8", self.n_docs + 1, at := at + 8 * self.n_docs)
        self.blocks = np.frombuffer(self.data, "<i8", n_blocks, at := at + 8 * (self.n_docs + 1))
        self.start = at + 8 * n_blocks

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from position ``start`` up to ``stop``; only the blocks that hold them are unpacked."""
        out = []
        for b in range(start // self.block, -(-stop // self.block) if stop > start else 0):
            n = min(self.block, self.n_ids - b * self.block)
            at = self.start + int(self.blocks[b])
            got = unpack(self.data[at : at + (n * self.width + 7) // 8], n, self.width)
            out.append(got[max(0, start - b * self.block) : stop - b * self.block])
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)

    def document(self, index: int) -> np.ndarray:
        return self.ids(int(self.offsets[index]), int(self.offsets[index + 1]))


class WordCache:
    """Ids of the tokenizer's whole texts, put together from those of their words.

    White space ends every pre-token of this tokenizer and normalisation never crosses it, so a
    text's ids are those of its words, one after the other.  A text that holds an added token's
    string goes to the library whole.  Words are numbered by Arrow, and their ids are kept end to end
    in one array, from which a text's are gathered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._load(path)
        self._reset()

    def _reset(self) -> None:
        self.memo = {b"": 0}  # white space at a text's ends
        self.ids = np.empty(0, dtype=np.uint32)
        self.starts = self.sizes = np.zeros(1, dtype=np.int64)

    def _load(self, path: str) -> None:
        """Merge table, if the tokenizer is of the lower-case kind that :meth:`merged` covers."""
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.cut = None
        if model["type"] != "BPE" or len(model["vocab"]) >= 1 << 24 or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            return
        vocab, suffix, letters = model["vocab"], model["end_of_word_suffix"] or "", byte_letters()
        cut = regex.compile(steps[0]["pattern"]["Regex"] + r"|\n").findall
        if cut("a\n.\n1") != ["a", "\n", ".", "\n", "1"]:
            return
        self.cut = cut
        self.inner, self.last = (np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64) for end in ("", suffix))
        pairs = [merge if isinstance(merge, list) else merge.split(" ") for merge in model["merges"]]
        self.keys = np.array([*(vocab[left] << 32 | vocab[right] for left, right in pairs), -1], dtype=np.int64)  # by rank
        self.table = np.full(1 << SLOTS, -1, dtype=np.int64)
        slot, todo = slots_of(self.keys[:-1]), np.arange(len(pairs))
        while len(todo):  # each pair goes to the first free slot from its own on
            free = todo[self.table[slot[todo]] < 0]
            self.table[slot[free]] = free
            todo = todo[self.table[slot[todo]] != todo]
            slot[todo] = slot[todo] + 1 & (1 << SLOTS) - 1
        self.new = np.array([vocab[left + right] for left, right in pairs], dtype=np.int64)

    def add(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each) of an Arrow array of words, none of them empty.

        Short Latin-1 words, which normalisation only lower-cases, are merged exactly here, others by the library.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        offsets, data = flat(words)
        lengths = np.diff(offsets)
        owner = lambda where: np.searchsorted(offsets, np.flatnonzero(where), side="right") - 1
        here = lengths <= LONG if self.cut else np.zeros(len(words), dtype=bool)
        here[owner(data >= 0xC4)] = False  # from U+0100 on
        plain = here.copy()
        plain[owner((data >= 0x80) | (data == 0x27) | (data == 0x3C))] = False  # contractions and markers begin with ' and <
        latin = here & ~plain
        parts, sizes = [np.empty(0, np.uint32)] * 3, np.zeros(len(words), dtype=np.int64)
        if plain.any():
            at, raw = flat(words.filter(pa.array(plain)))
            kind = KINDS[raw]
            first = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 1)])
            first[at[:-1]] = True
            cuts = np.flatnonzero(first)
            pieces = binary(np.append(cuts, len(raw)), LOWER[raw])
            parts[0], n = self.of_pieces(pieces.dictionary_encode())
            sizes[plain] = np.add.reduceat(n, np.searchsorted(cuts, at[:-1]))
        if latin.any():
            text = b"\n".join(words.filter(pa.array(latin)).to_pylist()).decode("utf-8", "replace")
            if "\ufffd" in text:
                here &= plain
            else:
                pieces = pa.array([x.encode() for x in self.cut(text.lower())], pa.binary()).dictionary_encode()
                parts[1], n = self.of_pieces(pieces)
                upto = np.cumsum(n)
                ends = np.flatnonzero(pieces.indices.to_numpy() == pc.index(pieces.dictionary, b"\n").as_py())
                sizes[latin] = np.diff(np.append(upto[ends], upto[-1]), prepend=0)
        if not here.all():
            found = self.by_library(words.filter(pa.array(~here)).to_pylist())
            sizes[~here] = [len(x) for x in found]
            parts[2] = np.concatenate(found)
        starts, before = np.zeros(len(words), dtype=np.int64), 0
        for which, part in ((plain, parts[0]), (here & ~plain, parts[1]), (~here, parts[2])):
            starts[which] = before + np.cumsum(sizes[which]) - sizes[which]
            before += len(part)
        return gather(np.concatenate(parts), starts, sizes, np.cumsum(sizes) - sizes), sizes

    def of_pieces(self, coded) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each) of dictionary-coded pieces; line feeds have none."""
        import pyarrow.compute as pc

        made, n = self.merged(*flat(coded.dictionary))
        starts, own = np.cumsum(n) - n, coded.indices.to_numpy()
        n = np.where(pc.equal(coded.dictionary, b"\n").to_numpy(zero_copy_only=False), 0, n)[own]
        return gather(made, starts[own], n, np.cumsum(n) - n), n

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``RANKLESS`` for pairs that never merge, by a table with open addressing."""
        key = left << 32 | right
        slot = slots_of(key)
        at = self.table[slot]
        hit = self.keys[at] == key
        out = np.where(hit, at, RANKLESS)
        rest = np.flatnonzero((at >= 0) & ~hit)
        while len(rest):
            slot[rest] = slot[rest] + 1 & (1 << SLOTS) - 1
            at = self.table[slot[rest]]
            hit = self.keys[at] == key[rest]
            out[rest[hit]] = at[hit]
            rest = rest[(at >= 0) & ~hit]
        return out

    def merged(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each) of pieces, merged side by side: in each turn every piece merges its pair of lowest rank, from the left.

        ``rank[i]`` is the rank of the ids at i and i + 1, and ``RANKLESS`` at the end of a piece.
        """
        done_parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes, counts = np.diff(offsets).astype(np.int64), np.zeros(len(offsets) - 1, dtype=np.int64)
        index, ends = np.arange(len(sizes)), np.cumsum(sizes) - 1
        ids = self.inner[data]
        ids[ends] = self.last[data[ends]]
        rank = np.full(len(ids), RANKLESS, dtype=np.int64)
        rank[:-1] = self.lookup(ids[:-1], ids[1:])
        rank[ends] = RANKLESS
        while len(index):
            first = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            done = best >> 32 == RANKLESS
            if done.any():
                ready = np.repeat(done, sizes)
                counts[index[done]] = sizes[done]
                done_parts.append((index[done], sizes[done], ids[ready].astype(np.uint32)))
                ids, rank, index, sizes = ids[~ready], rank[~ready], index[~done], sizes[~done]
                continue
            at = best & 0xFFFFFFFF
            ids[at] = self.new[best >> 32]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, rank, at = ids[keep], rank[keep], at - np.arange(len(at))
            sizes = sizes - 1
            last = np.cumsum(sizes) - 1
            rank[at] = RANKLESS
            right, left = at[at < last], at[at > last - sizes + 1]
            rank[right] = self.lookup(ids[right], ids[right + 1])
            rank[left - 1] = self.lookup(ids[left - 1], ids[left])
        out, starts = np.empty(int(counts.sum()), dtype=np.uint32), np.cumsum(counts) - counts
        for which, n, found in done_parts:
            out[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
        return out, counts

    def by_library(self, words: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def numbers(self, words) -> np.ndarray:
        """The place of each word of an Arrow array (distinct ones) in ``starts`` and ``sizes``; unknown ones are encoded together."""
        import pyarrow as pa

        listed = words.to_pylist()
        at = np.fromiter(map(self.memo.get, listed, repeat(-1)), dtype=np.int64, count=len(listed))
        if len(missing := np.flatnonzero(at < 0)):
            fresh = words.take(pa.array(missing))
            ids, sizes = self.add(fresh)
            at[missing] = np.arange(len(self.sizes), len(self.sizes) + len(missing))
            keep = np.diff(flat(fresh)[0]) <= LONG
            self.memo.update(zip(*((compress(x, keep)) for x in (map(listed.__getitem__, missing.tolist()), at[missing].tolist())), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        return at

    def encode_column(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each text) of an Arrow string array; null counts as empty; ``end_id`` ends each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.memo) > MEMO or len(self.ids) > IDS:
            self._reset()
        texts = pc.fill_null(column, "")
        odd = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = self.by_library([t or b"" for t in texts.filter(pa.array(odd)).cast(pa.binary()).to_pylist()]) if odd.any() else []
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        coded = words.flatten().cast(pa.binary()).dictionary_encode()
        place = self.numbers(coded.dictionary)
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        number = place[coded.indices.to_numpy()]
        starts, sizes = self.starts, self.sizes
        stored = self.ids
        extra, extra_at = [], []
        if end_id is not None or whole:
            # of each text one more entry: the ids of a text that went to the library, and the end
            tail = [*whole, np.empty(0, np.uint32)]
            if end_id is not None:
                tail = [np.append(x, np.uint32(end_id)) for x in tail]
            n = np.array([len(x) for x in tail])
            extra, extra_at = n, len(stored) + np.cumsum(n) - n
            stored = np.concatenate([stored, *tail])
            which = np.full(len(texts), len(tail) - 1)
            which[odd] = np.arange(len(whole))
            number = np.insert(number, ends, len(sizes) + which)
            ends = ends + np.arange(1, len(ends) + 1)
            starts, sizes = np.concatenate([starts, extra_at]), np.concatenate([sizes, extra])
        per_word = sizes[number]
        so_far = np.concatenate([[0], np.cumsum(per_word)])
        return gather(stored, starts[number], per_word, so_far[:-1]), np.diff(so_far[ends], prepend=0)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        ids, sizes = self.encode_column(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an Arrow binary array without nulls."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :] if at else np.zeros(1, np.int32)
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def binary(offsets: np.ndarray, data: np.ndarray):
    """An Arrow binary array of the given offsets and bytes."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).view(np.int64)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``sizes`` values from ``starts`` on, end to end; ``at`` is where each run comes to lie."""
    return values[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))]


def slices(column, size: int):
    """Ranges of rows of an Arrow string array that hold about ``size`` bytes, one row at least."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i = 0
    while i < len(upto):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + size, side="right")))
        yield i, j
        i = j


_caches: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 1, block: int = BLOCK) -> list[tuple[str, int, int, int]]:
    """Encode every text, append ``end_id`` and write files in ascending doc_id order under ``folder``.

    Returns the manifest: (file, rank of its partition, documents, ids) of each file in order; a partition
    writes a file for every ``FILE_IDS`` ids or so.  A file gets its name from the attempt that wrote it;
    only files of attempts that succeeded are listed, so retried or speculative tasks leave nothing that is read.
    """
    import pyarrow as pa
    from tokenizers import Tokenizer

    width = width_for(Tokenizer.from_file(path).get_vocab_size())

    def run(batches):
        from pyspark import TaskContext

        cache, rank, n_files = _cache(path), TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, n_null = [], [], [], 0
        store, at = _filesystem(folder)

        def made():
            nonlocal n_files, n_null
            name = f"{at}/part-{rank:06d}-{n_files:04d}-{uuid.uuid4().hex}.tide"
            n_files += 1
            store.create_dir(at, recursive=True)
            count = sum(map(len, ids)), sum(map(len, doc_ids))
            with store.open_output_stream(name) as f:
                write_file(f, np.concatenate(doc_ids), np.concatenate(lengths), np.concatenate(ids), width, block, n_null)
            for x in (ids, doc_ids, lengths):
                x.clear()
            n_null = 0
            return pa.RecordBatch.from_pydict({"file": [name], "rank": [rank], "seq": [n_files], "n_docs": [count[1]], "n_ids": [count[0]]})

        for batch in batches:
            for i, j in slices(batch.column(1), CHUNK):
                own = batch.column(0).slice(i, j - i)
                found, sizes = cache.encode_column(batch.column(1).slice(i, j - i), end_id)
                ids.append(found.astype(np.uint16 if width <= 16 else np.uint32))
                lengths.append(sizes)
                n_null += own.null_count
                doc_ids.append(own.fill_null(0).to_numpy())
                if sum(map(len, ids)) >= FILE_IDS:
                    yield made()
        if ids:
            yield made()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(run, "file string, rank long, seq long, n_docs long, n_ids long").collect()  # one row for each file of ``FILE_IDS``
    return [(r.file, r.rank, r.n_docs, r.n_ids) for r in sorted(rows, key=lambda r: (r.rank, r.seq))]


def read_digest(spark, folder: str, manifest: list[tuple[str, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""
    import pyarrow as pa

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0, *(r[3] for r in manifest)]).tolist()
    files = spark.createDataFrame([(r[0], s) for r, s in zip(manifest, starts, strict=False)], "file string, start long")

    def run(batches):
        store, _ = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    reader = Reader(f.read_buffer())
                for first in range(0, reader.n_docs, 4096):
                    last = min(reader.n_docs, first + 4096)
                    offsets = reader.offsets[first : last + 1]
                    ids = reader.ids(int(offsets[0]), int(offsets[-1])).astype("<u4").tobytes()
                    view, rel = memoryview(ids), ((offsets - offsets[0]) * 4).tolist()
                    crc = [zlib.crc32(view[a:b]) for a, b in zip(rel, rel[1:])]
                    own = reader.doc_ids[first:last]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=np.arange(first, last) < reader.n_null), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(len(manifest), "file").mapInArrow(run, schema)


def op5_token_files(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = run_folder(spark, "token-ids")
    manifest = write_ids(table(spark, sf_dir, "documents"), folder, path or public_tokenizers.path("word_bpe_49k.json"))
    return read_digest(spark, folder, manifest)
