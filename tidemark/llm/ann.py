"""Approximate nearest neighbours: hierarchical k-means tree, best bin first.

Equal vectors form a class, searched once; of its rows only the k + 1 with the smallest ids can be
among any query's k nearest, so these stand for it.  The upper levels of the tree are fitted on a
bounded sample of the classes; its cells hold about ``CELL`` classes at any size of the table (crowded
cells are cut into blocks of at most ``BLOCK`` or so).  In each block a task goes on with the tree,
over all vectors of the block, down to leaves of at most ``LEAF``: the number of leaves grows with the table.

A node's bound for a query is the cosine that a vector of the node would have if the part of it across the node's
centre pointed towards the query by the share ``z``; with z = 1 no vector does better (but for the spread of the
cosines to the centre).  A query first searches its own block with ``FIRST`` for z.  Then a priority queue hands
out cells by bound, and in each cell's blocks another one nodes and leaves, as long as their bound reaches the
(k + 1)-th cosine found so far; that is how visits widen.  ``z`` is calibrated: a bounded set of queries is
answered exactly, block by block over all vectors, and z is the least of ``STEPS`` with which the search finds
``RECALL`` of their true neighbours.

Defined cases: vectors that are null, zero or hold a null or non-finite component, and rows without a vec_id, take
no part; vectors of several lengths (a cosine needs one) are searched within the most frequent one; ties go to the
smaller id; repeated rows are queries and candidates one by one, and a query leaves out its own row only; an empty
table gives no rows; with fewer than k candidates a query gets them all; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, run_folder, table

#: Most vectors in the sample that the upper levels are fitted on, and least of them in a cell.
SAMPLE = 40_000
LEAST = 8
BRANCH = 8
#: Classes in a cell, most in a block, and most in a leaf.
CELL = 4096
BLOCK = 8192
LEAF = 48
#: Calibration queries, and the share of their true neighbours that must be visited.
CALIBRATION = 200
RECALL = 0.95
STEPS = [i / 40 for i in range(8, 40)] + [1.0, 1.25, 1.5, 2.0]
#: The z with which a query searches its own block, before the calibration.
FIRST = 0.5
SEED = 20
#: Cosines this near count as equal until they are summed alike.
NEAR = 1e-9


class Tree:
    """Node i has ``centres[i]`` [m, d], the mean cosine of each child's vectors to its centre, and children (leaf number where negative)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            self._grow(points, np.arange(len(points)), leaf, branch, rng)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int, branch: int, rng) -> int:
        """Number of the node over ``rows``; leaves are numbered -1, -2, ..."""
        own, centres = (None, None) if len(rows) <= leaf else kmeans(points[rows], min(branch, -(-len(rows) // leaf)), rng)
        if own is None or len(used := np.unique(own)) == 1:
            self.members.append(rows)
            return -len(self.members)
        number = len(self.nodes)
        self.nodes.append((centres[used], np.array([(points[rows[own == u]] @ centres[u]).mean() for u in used]), []))
        for u in used:
            self.nodes[number][2].append(self._grow(points, rows[own == u], leaf, branch, rng))
        return number

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of each unit vector: nearest centre at every node."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            centres, _, children = self.nodes[node]
            own = np.argmax(points[rows] @ centres.T, axis=1)
            for i, child in enumerate(children):
                part = rows[own == i]
                if len(part) and child < 0:
                    out[part] = -child - 1
                elif len(part):
                    todo.append((child, part))
        return out

    def walk(self, query: np.ndarray, z: float):
        """(leaf, bound) of every leaf, best bin first; send() a cosine to end at the first bound below it."""
        if not self.nodes:
            yield 0, 1.0
            return
        heap, tick, least = [(-1.0, 0, 0)], 1, -2.0
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < least:
                return
            if node < 0:
                least = max(least, (yield -node - 1, -bound) or -2.0)
                continue
            centres, mean, children = self.nodes[node]
            towards, across = parts_of(centres @ query, mean)
            for b, child in zip((-towards - z * across).tolist(), children, strict=True):
                heapq.heappush(heap, (b, tick, child))
                tick += 1

    def paths(self) -> list[list[tuple[int, int]]]:
        """For each leaf the (node, child) pairs that lead to it."""
        out: list = [[] for _ in self.members]
        todo = [(0, [])] if self.nodes else []
        while todo:
            node, path = todo.pop()
            for i, child in enumerate(self.nodes[node][2]):
                if child < 0:
                    out[-child - 1] = [*path, (node, i)]
                else:
                    todo.append((child, [*path, (node, i)]))
        return out

    def needed(self, query: np.ndarray, path: list[tuple[int, int]], least: float) -> float:
        """The least z with which all bounds along a path reach ``least``."""
        z = 0.0
        for node, i in path:
            towards, across = parts_of(self.nodes[node][0][i] @ query, self.nodes[node][1][i])
            z = max(z, float((least - NEAR - towards) / max(across, 1e-12)))
        return z


def parts_of(cosine, mean):
    """What a vector at ``mean`` cosine to a centre has along it, and at most across it, of a query at ``cosine``."""
    return mean * cosine, np.sqrt(np.maximum(0.0, 1 - mean * mean) * np.maximum(0.0, 1 - cosine * cosine))


def kmeans(points: np.ndarray, k: int, rng, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each unit vector, unit centres)."""
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = (own[None, :] == np.arange(k)[:, None]).astype(float) @ points
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-12
        centres = np.where(good[:, None], sums / np.where(good, norms, 1)[:, None], centres)
    return np.argmax(points @ centres.T, axis=1), centres


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1)[:, None]


class Best:
    """The k + 1 nearest rows of a query so far, by classes; ``least`` is the cosine to reach."""

    def __init__(self, k: int, least: float = -2.0):
        self.k, self.floor, self.least = k, least, least
        self.rows: list[tuple[float, int]] = []  # (approximate cosine, class in the block)

    def offer(self, near: np.ndarray, members: np.ndarray, weight: np.ndarray) -> None:
        hit = np.flatnonzero(near >= self.least - NEAR)
        if len(hit):
            self.rows += zip(near[hit].tolist(), members[hit].tolist(), strict=True)
            self.rows.sort(reverse=True)
            n = 0
            for i, (cosine, member) in enumerate(self.rows):
                n += int(weight[member])
                if n > self.k:
                    self.least = max(self.floor, cosine)
                    while i + 1 < len(self.rows) and self.rows[i + 1][0] >= cosine - NEAR:
                        i += 1
                    del self.rows[i + 1 :]
                    break


class Block:
    """A block's classes with the lower levels of the tree."""

    def __init__(self, vectors: np.ndarray, members: list[list[tuple[int, int]]]):
        """members: (vec_id, row) of the k + 1 first rows of each class."""
        self.vectors, self.members = vectors, members
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.weight = np.array([len(m) for m in members])
        self.tree = Tree(vectors / self.norms[:, None])

    def near(self, query: np.ndarray, k: int, least: float, z: float | None) -> tuple[Best, int]:
        """What a walk finds, and how many classes it looks at; without z all are."""
        best = Best(k, least)
        if z is None:
            best.offer((self.vectors @ query) / self.norms, np.arange(len(self.norms)), self.weight)
            return best, len(self.norms)
        walk, looked = self.tree.walk(query, z), 0
        try:
            leaf, bound = next(walk)
            while bound >= best.least - NEAR:
                rows = self.tree.members[leaf]
                best.offer((self.vectors[rows] @ query) / self.norms[rows], rows, self.weight)
                looked += len(rows)
                leaf, bound = walk.send(best.least - NEAR)
        except StopIteration:
            pass
        return best, looked

    def search(self, query: np.ndarray, k: int, least: float, z: float | None) -> tuple[list[tuple[float, int, int]], int]:
        """The k + 1 nearest rows (cosine, vec_id, row) that reach ``least``, and how many classes were looked at."""
        size = np.sqrt((query * query).sum())
        best, looked = self.near(query / size, k, least, z)
        at = np.array([m for _, m in best.rows], dtype=np.int64)
        cosine = (self.vectors[at] * query).sum(axis=1) / (self.norms[at] * size)  # summed alike for every pair
        found = [(float(c), vec, row) for c, m in zip(cosine, at, strict=True) for vec, row in self.members[m]]
        return sorted(found, key=lambda x: (-x[0], x[1], x[2]))[: k + 1], looked

    def needed(self, query: np.ndarray, k: int, least: float) -> list[tuple[float, int, float]]:
        """(cosine, class, least of ``STEPS`` that finds it, or 9) of the k + 1 nearest by brute force."""
        exact = self.near(query, k, -2.0, None)[0].rows
        wanted, z = {m for c, m in exact if c >= least - NEAR}, {}
        for step in STEPS:
            if not wanted:
                break
            hit = wanted & {m for _, m in self.near(query, k, least, step)[0].rows}
            z |= dict.fromkeys(hit, step)
            wanted -= hit
        return [(c, m, z.get(m, 9.0)) for c, m in exact]


def usable(vectors: DataFrame, column: str, is_query) -> tuple[DataFrame, int]:
    """(vec_id, row, v, asks, h1, h2) of the rows whose vector can take part, and its length; row numbers them, h1 and h2 hash v."""
    wide = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    wide = wide.where(fine)
    sizes = wide.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 0
    return wide.where(F.size("v") == size).select("vec_id", F.monotonically_increasing_id().alias("row"), "v", "asks", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), size


KEY = ["h1", "h2"]
BLOCKS = "cell long, block long, body binary, h1 long, h2 long, v array<double>, least double, found array<struct<away: double, vec_id: long, row: long>>"


def search(vectors: DataFrame, is_query, column: str = "embedding", k: int = 5, recall: float = RECALL, looked: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row where ``is_query`` holds.

    With ``looked`` instead one row: classes looked at and those that all queries' classes would meet by brute force.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    rows, size = usable(vectors, column, is_query)
    schema = "query_id long, rank int, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], schema)
    rows = checkpoint(rows)
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id", "row"))
    classes = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy(*KEY).agg(F.any_value("v").alias("v"), F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("rows"))
    asking = rows.where("asks").select(*KEY).distinct().withColumn("asks", F.lit(True))
    classes = checkpoint(classes.join(asking, KEY, "left"))
    total = classes.count()
    part = int(min(1.0, SAMPLE / total) * 2**31)
    drawn = classes.where(F.pmod("h1", F.lit(2**31)) < part).orderBy("h1").select("v").collect()  # about SAMPLE rows
    sample = unit(np.array([r.v for r in drawn])) if drawn else np.zeros((0, size))
    top = Tree(sample, leaf=max(LEAST, CELL * len(sample) // total))
    top.members = [m[:0] for m in top.members] or [np.empty(0)]  # not needed any more
    shared = spark.sparkContext.broadcast(top)

    def place(batches):
        for batch in batches:
            cells = shared.value.assign(unit(matrix(batch.column(2), size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    placed = checkpoint(classes.select(*KEY, "v", "rows", "asks").mapInArrow(place, "h1 long, h2 long, v array<double>, rows array<struct<vec_id: long, row: long>>, asks boolean, cell long"))
    n_blocks = {r.cell: -(-r["count"] // BLOCK) for r in placed.groupBy("cell").count().collect()}  # a row for each cell
    cut = F.broadcast(spark.createDataFrame(sorted(n_blocks.items()), "cell long, n long"))
    dealt = placed.join(cut, "cell").withColumn("block", F.pmod("h2", F.col("n")))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h1", "ascending"), ("h2", "ascending")])
        v = matrix(group.column("v").combine_chunks(), size)
        made = Block(v, [[(m["vec_id"], m["row"]) for m in x] for x in group.column("rows").to_pylist()])
        at = np.flatnonzero(group.column("asks").fill_null(False).to_numpy())
        own = [made.search(q, k, -2.0, FIRST)[0] for q in v[at]]
        n, none = len(at), [None]
        columns = [
            [group.column("cell")[0].as_py()] * (n + 1),
            [group.column("block")[0].as_py()] * (n + 1),
            [pickle.dumps(made), *none * n],
            [None, *group.column("h1").take(pa.array(at)).to_pylist()],
            [None, *group.column("h2").take(pa.array(at)).to_pylist()],
            [None, *v[at].tolist()],
            [None, *(x[k][0] if len(x) > k else -2.0 for x in own)],
            [None, *([{"away": -c, "vec_id": vec, "row": row} for c, vec, row in x] for x in own)],
        ]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    found_type = pa.list_(pa.struct([("away", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), found_type]
    names = ["cell", "block", "body", *KEY, "v", "least", "found"]
    folder = run_folder(spark, "ann-blocks")
    dealt.groupBy("cell", "block").applyInArrow(build, BLOCKS).write.parquet(folder)
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    bodies, queries = blocks.where("body is not null").select("cell", "block", "body"), blocks.where("body is null").drop("body")
    z = calibrate(bodies, queries, top, size, k, recall)
    by_cell = spark.sparkContext.broadcast(n_blocks)

    def ask(batches):
        for batch in batches:
            own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            v, least = matrix(batch.column(4), size), batch.column(5).to_numpy()
            at, cells, parts = [], [], []
            for i, q in enumerate(unit(v)):
                for cell, bound in shared.value.walk(q, z):
                    if bound < least[i] - NEAR:
                        break
                    for b in range(by_cell.value.get(cell, 0)):
                        if z > FIRST or (cell, b) != own[i]:
                            at.append(i)
                            cells.append(cell)
                            parts.append(b)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(parts, pa.int64()), *[c.take(take) for c in batch.columns[2:]]], ["cell", "block", *KEY, "v", "least"])

    asked = queries.select("cell", "block", *KEY, "v", "least").mapInArrow(ask, "cell long, block long, h1 long, h2 long, v array<double>, least double")

    def meet(questions: pa.Table, stored: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if questions.num_rows and stored.num_rows:
            block = pickle.loads(stored.column("body")[0].as_py())
            h1, h2, least = (questions.column(c).to_pylist() for c in (*KEY, "least"))
            for i, q in enumerate(matrix(questions.column("v").combine_chunks(), size)):
                got, n = block.search(q, k, least[i], z)
                if looked:
                    out.append((h1[i], h2[i], float(n), 0, 0))
                else:
                    out += [(h1[i], h2[i], -c, vec, row) for c, vec, row in got]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], [*KEY, "away", "vec_id", "row"])

    near = asked.groupBy("cell", "block").cogroup(bodies.groupBy("cell", "block")).applyInArrow(meet, "h1 long, h2 long, away double, vec_id long, row long")
    if looked:
        return near.agg(F.coalesce(F.sum("away"), F.lit(0.0)).alias("looked"), F.lit(float(total) * queries.count()).alias("pairs"))
    every = near.unionByName(queries.select(*KEY, F.explode("found").alias("x")).select(*KEY, "x.*"))  # both may hold a row
    best = every.withColumn("n", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("away", "vec_id", "row"))).where(F.col("n") <= k + 1)
    lists = best.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("away", "vec_id", "row"))).alias("best"))
    answered = rows.where("asks").select(F.col("vec_id").alias("query_id"), "row", *KEY).join(lists, KEY)
    others = answered.withColumn("best", F.slice(F.filter("best", lambda x: x["row"] != F.col("row")), 1, k))
    found = others.select("query_id", F.posexplode("best").alias("at", "x"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.away")).alias("score"))


def matrix(column, size: int) -> np.ndarray:
    """Rows of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def calibrate(bodies: DataFrame, queries: DataFrame, top: Tree, size: int, k: int, recall: float) -> float:
    """The z with which ``recall`` of the true neighbours of a bounded query set are visited."""
    import pyarrow as pa

    known = queries.orderBy("h2", "h1").limit(CALIBRATION).select("v", "least", F.col("found.row").alias("rows")).collect()
    if not known:
        return 1.0
    asked = unit(np.array([r.v for r in known]))
    shared, upper = queries.sparkSession.sparkContext.broadcast(([r.least for r in known], asked)), top.paths()

    def exact(batches):
        for batch in batches:
            out = []
            for cell, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                block = pickle.loads(body)
                for i, (least, q) in enumerate(zip(*shared.value, strict=True)):
                    for c, m, z in block.needed(q, k, least):
                        out += [(i, -c, vec, row, cell, z) for vec, row in block.members[m]]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()], strict=True)], ["q", "away", "vec_id", "row", "cell", "z"])

    near = bodies.mapInArrow(exact, "q long, away double, vec_id long, row long, cell long, z double")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("away", "vec_id", "row"))).where(F.col("n").between(2, k + 1))  # the first is the query's own
    needed = sorted(0.0 if r.row in known[r.q].rows else max(r.z, top.needed(asked[r.q], upper[r.cell], known[r.q].least)) for r in ranked.collect())  # k rows for each of CALIBRATION queries
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1.0


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
