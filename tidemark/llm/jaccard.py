"""Join of documents by the Jaccard similarity of their word n-grams.

A document is the set of its distinct n-word shingles.  The method:

1. Equal sets form classes (128-bit hash of the sorted set); one set stands for each.
2. Candidate regions.  Sets that link share at least L of the P smallest shingle hashes of each, so
   they share one of their rarest P - L + 1 of these (rarity counted over the whole corpus).  Only
   shingles that several sets hold can bring sets together; sets connected by them form a region.
3. In each region the shingles are hashed into groups, the counts of a set's groups are a point,
   and an R-tree of the points is searched: the overlap with any set of a box is at most the sum over
   the groups of the smaller of count and box top.  Pairs that survive the bound are verified on the
   sets, unless they are connected already.
4. Linked sets are united; large regions are searched chunk against chunk by many tasks.

No step lists the pairs of a group, and none drops a set: step 2 loses no link (prefix filtering is
exact for every global order of tokens), step 3 none either (the bound is an upper bound).

Defined cases: null texts and texts without words are empty sets, linked with nothing; texts with
fewer words than n are one shingle, the whole sequence; repeated rows and repeated ids each get their
row, an id's texts count one by one; a row with a null id belongs to the class of its equal texts, and if none of these has an id its
component is null and it links nothing; ties need no rule; extra columns are ignored by :func:`join`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, checkpoint, counted, release, run_folder, table, text_bytes
from .graph import components

WORDS = 4
PERCENT = 85
#: Groups of shingles, the dimensions of the R-tree.
GROUPS = 64
#: Further hashes kept for rarity, as a share of the set.
EXTRA = 0.15
#: Sets of a region that one task searches at once: a twentieth of the region, but so many at least and at most.
LEAST_CHUNK = 300
CHUNK = 8000
MEMO = 200_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: bytes, memo: Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    m = len(h) - width + 1
    s = np.full(m, width, dtype=np.uint64)
    for k in range(width):
        s = (s ^ (s >> np.uint64(31))) * MIX[k % 4] + h[k : k + m]
    s = (s ^ (s >> np.uint64(29))) * MIX[1]
    return np.unique(s ^ (s >> np.uint64(32)))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The smallest intersection of a set of ``n`` with any set it links with."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    return int(EXTRA * n)


def kept(n: int, percent: int = PERCENT) -> int:
    """P: how many of its smallest hashes a set of ``n`` hands on."""
    return min(n, n - least_overlap(n, percent) + 1 + extra(n))


def needed(n: int, percent: int = PERCENT) -> int:
    """P - L + 1: how many of the rarest of these must be tried; L is that of its smallest partner."""
    return max(1, kept(n, percent) - extra(least_overlap(n, percent)))


class CountTree:
    """R-tree over group counts, packed by sorting the points on their size and then their counts."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points.T[:4], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # tops, least size, most size of boxes
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > self.FAN:
            cuts = np.arange(0, len(top), self.FAN)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, bounds) of points whose overlap bound allows a link with ``point``, largest bound first."""
        live = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[live] for x in self.levels[depth])
            bound = np.minimum(top, point).sum(axis=1)
            # a partner m of the box links only if (100 + percent) * overlap >= percent * (size + m)
            live = live[((100 + percent) * bound >= percent * (size + low)) & (100 * high >= percent * size) & (percent * low <= 100 * size)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            live = (live[:, None] * self.FAN + np.arange(self.FAN)).ravel()
            live = live[live < below]
        bound = np.minimum(self.points[live], point).sum(axis=1)
        fit = (100 + percent) * bound >= percent * (size + self.sizes[live])
        live, bound = live[fit], bound[fit]
        best = np.argsort(-bound, kind="stable")
        return self.order[live[best]], bound[best]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(sets: list[np.ndarray], left: range, right: range, percent: int = PERCENT) -> list[int]:
    """Union-find parents of ``sets`` after all links between ``left`` and ``right`` (equal: within)."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    points = np.array([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets], dtype=np.int32).reshape(-1, GROUPS)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tree = CountTree(points[right.start : right.stop], sizes[right.start : right.stop])
    within = left == right
    for i in left:
        found, _ = tree.search(points[i], int(sizes[i]), percent)
        for j in (found + right.start).tolist():
            if within and j <= i:
                continue
            a, b = root(i), root(j)
            if a != b and linked(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def signatures(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, hi, lo, prefix): size, 128-bit hash and smallest hashes of each document's set.

    A task hands on the prefix of equal sets once (null the other times).
    """
    import pyarrow as pa

    def run(batches):
        import xxhash

        memo, seen = Hashes(), set()
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                sizes, high, low, prefix = [], [], [], []
                for text in text_bytes(part.column(1)):
                    s = shingles(text, memo, n)
                    whole = xxhash.xxh3_128_digest(s.tobytes())
                    sizes.append(len(s))
                    high.append(int.from_bytes(whole[:8], "little", signed=True))
                    low.append(int.from_bytes(whole[8:], "little", signed=True))
                    if not len(s) or whole in seen:
                        prefix.append(None)
                        continue
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(whole)
                    prefix.append(s[: kept(len(s), percent)].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n", "hi", "lo", "prefix"])
        memo.clear()
        seen.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, prefix array<long>")


def regions(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root): low hashes of sets that may link with another, and their region."""
    rows = signed.where("prefix is not null").select(F.col("lo").alias("sid"), "n", F.explode("prefix").alias("token"))
    by_set = Window.partitionBy("sid")
    shared = beside(rows, "token", {"least": F.min("sid"), "most": F.max("sid"), "df": F.count("*")}, "least <> most").select("sid", "n", "token", "df").distinct()
    # tokens of one set only come first in the order, so the rest of the needed ones are shared
    p, lo = (F.least(F.col("n"), F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 + F.floor(F.lit(EXTRA) * F.col("n"))), F.ceil(percent * F.col("n") / 100))
    need = F.greatest(F.lit(1), p - F.floor(F.lit(EXTRA) * lo))
    ranked = shared.withColumn("rank", F.row_number().over(by_set.orderBy("df", "token"))).withColumn("held", F.count("*").over(by_set))
    folder = run_folder(signed.sparkSession, "tried")
    ranked.where(F.col("rank") <= need - (p - F.col("held"))).select("sid", "token").write.parquet(folder)
    tried = signed.sparkSession.read.parquet(folder)
    edges = beside(tried, "token", {"hub": F.min("sid"), "most": F.max("sid")}, "hub <> most").where("hub <> sid").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
    return components(edges)


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``."""
    import pyarrow as pa

    spark = docs.sparkSession
    folder = run_folder(spark, "signatures")
    signatures(docs, n, percent).write.parquet(folder)
    signed = spark.read.parquet(folder)
    region = regions(signed, percent)
    # one document stands for each set of a region
    classes = signed.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    members = checkpoint(classes.join(region, classes.lo == region.node).select("rep", "root").where("rep is not null"))
    sized = beside(members, "root", {"held": F.count("*")}, "held > 1")
    size = F.least(F.lit(CHUNK), F.greatest(F.lit(min(LEAST_CHUNK, CHUNK)), F.ceil(F.col("held") / 20)))
    sized = sized.withColumn("chunks", F.ceil(F.col("held") / size))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    # chunk i meets every chunk j >= i: a member goes to the pairs (i, j) and (j, i)
    spread = sized.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    tasks = spread.select("rep", "root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk")
    # text of a member, once for each task it is in
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(counted(members.select("rep").distinct()), "rep", "left_semi")
    work = tasks.join(texts, "rep")

    def solve(group: pa.Table) -> pa.Table:
        memo = Hashes()
        order = np.argsort(group.column("chunk").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        sets = [shingles(t, memo, n) for i in range(0, group.num_rows, 1024) for t in text_bytes(group.column("text").slice(i, 1024).combine_chunks())]
        chunk = group.column("chunk").to_numpy()
        cut = int((chunk == chunk[0]).sum())
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        if i == j:
            roots = link(sets, range(len(sets)), range(len(sets)), percent)
        else:
            roots = link(sets, range(cut), range(cut, len(sets)), percent) if cut < len(sets) else list(range(len(sets)))
        reps = group.column("rep").to_numpy()
        pairs = [(int(reps[k]), int(reps[r])) for k, r in enumerate(roots) if k != r]
        return pa.table({"a": pa.array([x[0] for x in pairs], pa.int64()), "b": pa.array([x[1] for x in pairs], pa.int64())})

    links = work.groupBy("root", "i", "j").applyInArrow(solve, "a long, b long")
    found = components(links.where("a <> b")).select(F.col("node").alias("rep"), F.col("root").alias("component"))
    by_class = classes.join(found, "rep", "left").select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n", "hi", "lo").join(by_class, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; rows without an id stay.

    An id of several texts goes with all of them if one links it to a smaller id.
    """
    other = join(docs.where("doc_id is not null"), n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(counted(other), "doc_id", "left_anti").select(docs.columns)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: The same by all shared shingles, in DuckDB's SQL.
SQL = r"""WITH RECURSIVE w0 AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
w1 AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w0 WHERE len(w) >= 4),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, i, n, hash(w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o) AS s FROM w1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= n - 3 UNION ALL SELECT doc_id, hash(array_to_string(w, ' ')) FROM w0 WHERE len(w) BETWEEN 1 AND 3),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
tw AS MATERIALIZED (SELECT sh.doc_id, sh.s FROM sh JOIN (SELECT s FROM sh GROUP BY 1 HAVING count(*) > 1) USING (s)),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM tw a JOIN tw b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS MATERIALIZED (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ed AS MATERIALIZED (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
rc AS (SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM ed) UNION SELECT ed.b, rc.r FROM rc JOIN ed ON ed.a = rc.doc_id WHERE rc.r < ed.b),
co AS (SELECT doc_id, min(r) AS component_id FROM rc GROUP BY 1)
SELECT d.doc_id, coalesce(sz.n, 0) AS n_shingles, coalesce(least(co.component_id, d.doc_id), d.doc_id) AS component_id FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN co USING (doc_id)"""
