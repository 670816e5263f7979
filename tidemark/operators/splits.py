"""Chronological splits with interval purging.  Folds are long tables, never index arrays."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import ContractError

END = "label_end_index"


def locked(events: DataFrame, boundary: int) -> DataFrame:
    """Events with their role: ``development`` ends before the boundary row, ``locked`` starts at it, others are ``dropped``."""
    role = F.when(F.col("row_id") >= boundary, "locked").when(F.col(END) < boundary, "development").otherwise("dropped")
    return events.withColumn("role", role)


def boundary_at(events: DataFrame, date) -> int:
    found = events.where(F.col("date") >= F.lit(date).cast("timestamp_ntz")).agg(F.min("row_id")).collect()[0][0]
    if found is None:
        raise ContractError("no row at or after the boundary")
    return found


def fractional_boundary(n: int, fraction: float, least: int) -> int:
    return min(max(int(n * (1 - fraction)), least), n - 1)


def positioned(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("row_id")
    return events.withColumn("pos", F.row_number().over(w) - 1)


def walk_forward(events: DataFrame, folds: int = 5, least_train: int = 280, gap: int = 0, least_validation: int = 1) -> DataFrame:
    """(symbol, fold_id, role, row_id): role is train, purged, embargoed or validation.

    Validation starts at the first position that leaves ``least_train`` rows after purge and gap, and before which at least
    as many lie; what follows is cut into ``folds`` equal blocks.  A row before a block trains unless its label reaches
    the block (purged) or it is one of the ``gap`` rows just before it (embargoed).  Symbols that can't hold
    ``folds`` blocks of ``least_validation`` rows have no folds.  At most ``folds`` boundaries a symbol are joined.
    """
    at = positioned(events.select("symbol", "row_id", END))
    # labels that end before row p: counted by merging ends and rows in one sorted run, less those within the gap
    by_row = Window.partitionBy("symbol").orderBy("row_id")
    near = sum((F.coalesce((F.lag(END, k).over(by_row) < F.col("row_id")).cast("int"), F.lit(0)) for k in range(1, gap + 1)), F.lit(0))
    marks = at.select("symbol", F.col(END).alias("x"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("pos"), F.lit(0).alias("near")).unionByName(at.select("symbol", F.col("row_id").alias("x"), F.lit(-1).alias("side"), "pos", near.alias("near")))
    run = Window.partitionBy("symbol").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = marks.withColumn("done", F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(run)).where("side = -1")
    first = ended.where((F.col("done") - F.col("near") >= least_train) & (F.col("pos") >= least_train)).groupBy("symbol").agg(F.min("pos").alias("first"))
    sizes = at.groupBy("symbol").agg(F.count("*").alias("n"))
    first = first.join(sizes, "symbol").where(F.col("first") <= F.col("n") - folds * least_validation)
    rest = at.join(F.broadcast(first), "symbol").where("pos >= first")  # one row a symbol
    blocks = rest.withColumn("fold_id", F.ntile(folds).over(Window.partitionBy("symbol").orderBy("pos")))
    cuts = blocks.groupBy("symbol", "fold_id").agg(F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"), F.min("row_id").alias("from_row"))
    both = at.join(F.broadcast(cuts), "symbol").where("pos <= to_pos")  # cuts: ``folds`` rows a symbol
    role = F.when(F.col("pos") >= F.col("from_pos"), "validation").when(F.col(END) >= F.col("from_row"), "purged").when(F.col("pos") >= F.col("from_pos") - gap, "embargoed").otherwise("train")
    return both.select("symbol", "fold_id", role.alias("role"), "row_id", END)


def fold_problems(folds: DataFrame, labels: DataFrame | None = None, keys=("symbol", "fold_id"), least_train: int = 1, least_validation: int = 1) -> DataFrame:
    """Folds with too few rows or, where ``labels`` (symbol, row_id, y) are given, a part without both classes."""
    rows = folds.where("role in ('train', 'validation')")
    if labels is not None:
        rows = rows.join(labels.select("symbol", "row_id", "y"), ["symbol", "row_id"])
    part = lambda r: F.count_if(F.col("role") == r)
    classes = lambda r: F.count_distinct(F.when(F.col("role") == r, F.col("y"))) if labels is not None else F.lit(2)
    counted = rows.groupBy(*keys).agg(part("train").alias("n_train"), part("validation").alias("n_validation"), classes("train").alias("train_classes"), classes("validation").alias("validation_classes"))
    return counted.where((F.col("n_train") < least_train) | (F.col("n_validation") < least_validation) | (F.col("train_classes") < 2) | (F.col("validation_classes") < 2))


def fold_overlaps(folds: DataFrame, keys=("symbol", "fold_id")) -> DataFrame:
    """Training rows whose closed interval meets one of their own fold's validation intervals."""
    part = lambda r: folds.where(F.col("role") == r).select(*keys, "row_id", END)
    return overlapping(part("train"), part("validation"), list(keys))


def assert_folds(folds: DataFrame, labels: DataFrame | None = None, keys=("symbol", "fold_id"), least_train: int = 1, least_validation: int = 1) -> DataFrame:
    """``folds``, unless one overlaps, is too small or lacks a class."""
    if bad := fold_problems(folds, labels, keys, least_train, least_validation).limit(1).collect():
        raise ContractError(f"unfit fold {bad[0].asDict()}")
    if bad := fold_overlaps(folds, keys).limit(5).collect():
        raise ContractError(f"training rows overlap validation: {[r.row_id for r in bad]}")
    return folds


def fold_counts(folds: DataFrame, keys=("symbol", "fold_id")) -> DataFrame:
    count = lambda r: F.count_if(F.col("role") == r)
    return folds.groupBy(*keys).agg(count("train").alias("n_train"), count("purged").alias("n_purged"), count("embargoed").alias("n_embargoed"), count("validation").alias("n_validation"), F.count_if(F.col("role").isin("train", "purged", "embargoed")).alias("n_raw"))


def nested(events: DataFrame, outer: int = 5, inner: int = 3, least_outer: int = 800, least_inner: int = 300) -> DataFrame:
    """(symbol, outer_fold, fold_id, role, row_id): inner folds over each outer fold's training rows."""
    top = walk_forward(events, outer, least_outer)
    train = top.where("role = 'train'").select(F.concat_ws("#", "symbol", "fold_id").alias("symbol"), "row_id", END)
    low = walk_forward(train, inner, least_inner)
    parts = F.split("symbol", "#")
    return low.select(F.element_at(parts, 1).alias("symbol"), F.element_at(parts, 2).cast("int").alias("outer_fold"), "fold_id", "role", "row_id", END)


def uncontained(events: DataFrame, outer: int, inner: int, least_outer: int, least_inner: int) -> DataFrame:
    """(outer_fold, fold_id, n_rows, n_outside): rows of inner folds, and how many of them are no training rows of the outer fold."""
    top = walk_forward(events, outer, least_outer).where("role = 'train'").select("symbol", F.col("fold_id").alias("outer_fold"), "row_id", F.lit(1).alias("held"))
    low = nested(events, outer, inner, least_outer, least_inner)
    return low.join(top, ["symbol", "outer_fold", "row_id"], "left").groupBy("outer_fold", "fold_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("held").isNull()).alias("n_outside"))


def with_fold_metadata(folds: DataFrame, keys=("symbol", "fold_id")) -> DataFrame:
    """Each row of the folds with its fold's counts and first validation row; folds are few, so their facts are broadcast."""
    facts = fold_counts(folds, keys).join(folds.where("role = 'validation'").groupBy(*keys).agg(F.min("row_id").alias("first_validation_row")), list(keys))
    return folds.join(F.broadcast(facts), list(keys))


def islands(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Closed intervals merged where they overlap or touch."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    grouped = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*keys, "__island").agg(F.min(start).alias("from_row"), F.max(end).alias("to_row")).drop("__island")


def overlapping(candidates: DataFrame, reference: DataFrame, keys: list[str], anti: bool = False) -> DataFrame:
    """Candidates (row_id, end) that overlap a reference interval, or do not (``anti``).

    Reference intervals become islands, which are disjoint and sorted; the last island that starts at or
    before a candidate's end is found by one sorted run, as in an as-of join: no nested loop.
    """
    isl = islands(reference, keys, "row_id", END)
    left = candidates.select(*keys, F.col(END).alias("__x"), F.lit(1).alias("__side"), F.struct(*candidates.columns).alias("__c"))
    right = isl.select(*keys, F.col("from_row").alias("__x"), F.lit(0).alias("__side"), F.col("to_row").alias("__to"))
    run = Window.partitionBy(*keys).orderBy("__x", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__reach", F.max("__to").over(run)).where("__side = 1")
    hit = F.coalesce(F.col("__reach") >= F.col("__c.row_id"), F.lit(False))
    return both.where(~hit if anti else hit).select("__c.*")


def cpcv(events: DataFrame, groups: int = 8, held: int = 2, embargo: int = 0) -> DataFrame:
    """(symbol, split_id, test_groups, role, row_id) of every choice of ``held`` test groups out of ``groups``."""
    at = positioned(events.select("symbol", "row_id", END)).withColumn("g", F.ntile(groups).over(Window.partitionBy("symbol").orderBy("row_id")) - 1)
    spark = events.sparkSession
    choices = spark.createDataFrame([(i, "|".join(map(str, c)), list(c)) for i, c in enumerate(combinations(range(groups), held))], "split_id int, test_groups string, chosen array<int>")
    spans = at.groupBy("symbol", "g").agg(F.min("row_id").alias("a"), F.max(END).alias("b"))
    # the first position after all labels of a group: the embargo counts positions from there
    spans = at.select("symbol", "row_id").join(F.broadcast(spans), "symbol").groupBy("symbol", "g", "a", "b").agg(F.count_if(F.col("row_id") <= F.col("b")).alias("late"))
    packed = spans.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("g", "a", "b", "late"))).alias("spans"))  # ``groups`` rows a symbol
    rows = at.join(F.broadcast(packed), "symbol").join(F.broadcast(choices))
    own = F.array_contains("chosen", F.col("g"))
    test = F.transform("chosen", lambda c: F.element_at("spans", c + 1))
    purge = F.exists(test, lambda s: (F.col("row_id") <= s["b"]) & (F.col(END) >= s["a"]))
    late = F.exists(test, lambda s: (F.col("pos") >= s["late"]) & (F.col("pos") < s["late"] + embargo))
    role = F.when(own, "validation").when(purge, "purged").when(late, "embargoed").otherwise("train")
    return rows.select("symbol", "split_id", "test_groups", role.alias("role"), "row_id", END)


#: Rows that are hashed as one text.
CHUNK = 1000


def manifest(folds: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of each fold's rows by role, in row order: the digest of the digests of ``CHUNK`` rows each."""
    item = F.concat_ws(":", "role", "row_id", END)
    at = folds.withColumn("chunk", F.floor(F.col("row_id") / CHUNK)).withColumn("item", F.struct("row_id", "role", item.alias("text")))
    chunks = at.groupBy(*keys, "chunk").agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"])), 256).alias("sha"), F.count("*").alias("n"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha"))), lambda x: x["sha"])
    return chunks.groupBy(*keys).agg(F.sha2(F.concat_ws(",", hashes), 256).alias("rows_sha256"), F.sum("n").alias("n_rows"))


def canonical_manifest(outer: DataFrame, inner: DataFrame, horizon: int, gap: int = 0) -> dict:
    """Exact JSON-compatible manifest of nested folds of one symbol; it names every row and label end, so it is made on the driver.

    ``outer`` has fold_id, ``inner`` outer_fold and fold_id.  :func:`tidemark.plans.governance.digest` of it is its canonical SHA-256.
    """
    def described(rows) -> dict:
        part = {r: [(x.row_id, x[END]) for x in rows if x.role == r] for r in ("train", "purged", "embargoed", "validation")}
        listed = lambda r: {"row_ids": [a for a, _ in part[r]], "label_end_indices": [b for _, b in part[r]]}
        return {"fold_id": f"wf_{rows[0].fold_id:02d}", "train": listed("train"), "validation": listed("validation"), "n_train": len(part["train"]), "n_validation": len(part["validation"]), "purged_count": len(part["purged"]), "pre_validation_gap_count": len(part["embargoed"])}

    def grouped(df: DataFrame, *keys: str) -> dict:
        out: dict = {}
        for r in df.orderBy(*keys, "row_id").collect():
            out.setdefault(tuple(r[k] for k in keys), []).append(r)
        return out

    tops, lows = grouped(outer, "fold_id"), grouped(inner, "outer_fold", "fold_id")
    parts = [{"outer": described(rows), "inner": [described(v) for k, v in sorted(lows.items()) if k[0] == fold]} for (fold,), rows in sorted(tops.items())]
    return {"protocol": "nested_purged_expanding_walk_forward_v1", "horizon": horizon, "outer_fold_count": len(parts), "inner_fold_count_per_outer": [len(p["inner"]) for p in parts], "purge_interval_convention": "closed_[row_id,label_end_index]", "pre_validation_gap_rows": gap, "post_validation_embargo_rows": 0, "outer_folds": parts}


def bits(n: int, k: int) -> list[int]:
    return [reduce(lambda m, i: m | 1 << i, c, 0) for c in combinations(range(n), k)]
