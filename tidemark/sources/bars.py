"""Sources of OHLCV bars: files, derived series, prefixes, partitions and signal tables."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close"]
REQUIRED = ["date", *PRICES, "volume"]
SCHEMA = T.StructType([T.StructField("date", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in [*PRICES, "volume"]]])
#: Headers of the terminal's tab export (fixed values).
TAB_HEADERS = {"<DATE>": "date", "<OPEN>": "open", "<HIGH>": "high", "<LOW>": "low", "<CLOSE>": "close", "<TICKVOL>": "tick_volume", "<VOL>": "real_volume", "<SPREAD>": "spread"}
SIGNAL_COLUMNS = ["entry_time", "exit_time", "direction", "signal_id"]


class ContractError(ValueError):
    """An input breaks its contract."""


def with_row_id(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    return df.withColumn("row_id", (F.row_number().over(w) - 1).cast("long"))


def canonical(df: DataFrame, symbol: str = "ONE") -> DataFrame:
    have = df if "symbol" in df.columns else df.withColumn("symbol", F.lit(symbol))
    return with_row_id(have).select("symbol", "row_id", "date", *PRICES, "volume")


def read_csv(spark: SparkSession, path: str, symbol: str = "ONE") -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ContractError(f"missing columns {missing}")
    return canonical(raw.select(F.to_timestamp_ntz("date").alias("date"), *[F.col(c).try_cast("double").alias(c) for c in [*PRICES, "volume"]]), symbol)


def select_volume(df: DataFrame, volume: str) -> DataFrame:
    """Explicit choice of tick or real volume; an existing volume must agree with it."""
    if volume not in df.columns:
        raise ContractError(f"no column {volume}")
    if "volume" in df.columns:
        if df.where(F.col("volume").isNotNull() & F.col(volume).isNotNull() & (F.col("volume") != F.col(volume))).limit(1).count():
            raise ContractError("volume conflicts with the chosen column")
        df = df.drop("volume")
    return df.withColumn("volume", F.col(volume).cast("double")).drop("tick_volume", "real_volume")


def read_tab_export(spark: SparkSession, path: str, symbol: str = "ONE") -> DataFrame:
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    if missing := [c for c in TAB_HEADERS if c not in raw.columns]:
        raise ContractError(f"missing columns {missing}")
    named = raw.select([F.col(f"`{a}`").alias(b) for a, b in TAB_HEADERS.items()])
    typed = named.select(F.to_timestamp_ntz("date", F.lit("yyyy.MM.dd")).alias("date"), *[F.col(c).try_cast("double").alias(c) for c in named.columns if c != "date"])
    return canonical(select_volume(typed, "tick_volume"), symbol)


#: Chance that a regime lasts another day, drifts of the two, and memory of the innovations.
STAY, DRIFTS, MEMORY = 0.965, (0.0008, -0.0006), 0.1


def synthetic(spark: SparkSession, n: int = 1500, seed: int = 42, symbols: int = 1) -> DataFrame:
    """Deterministic bars on business days: a two-state Markov drift, a slow volatility wave, autoregressive innovations.

    A state is the parity of the switches so far; an innovation's memory fades below 1e-12 within twelve days.
    """
    if n < 700:
        raise ContractError("at least 700 rows")
    base = spark.range(symbols * n).select((F.col("id") / n).cast("int").alias("s"), (F.col("id") % n).alias("row_id"))
    unit = lambda salt: (F.pmod(F.xxhash64("s", "row_id", F.lit(seed), F.lit(salt)), F.lit(1 << 24)) + 0.5) / float(1 << 24)
    w = Window.partitionBy("s").orderBy("row_id")
    walk = base.withColumns({"z": F.sqrt(-2 * F.ln(unit("a"))) * F.cos(2 * F.pi() * unit("b")), "switch": (unit("m") > STAY).cast("int")})
    walk = walk.withColumn("state", F.sum("switch").over(w) % 2)
    shock = sum((MEMORY**k * F.coalesce(F.lag("z", k).over(w), F.lit(0.0)) for k in range(1, 13)), F.col("z"))
    vol = 0.006 + 0.003 * F.sin(F.col("row_id") / 60.0)
    drift = F.when(F.col("state") == 0, DRIFTS[0]).otherwise(DRIFTS[1])
    walk = walk.withColumn("ret", drift + vol * shock).withColumn("close", 1200 * F.exp(F.sum("ret").over(w))).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(1200.0)))
    span = 1 + 0.004 * unit("c")
    day = F.expr("date_add(date'2014-01-01', cast((row_id + 2) div 5 * 7 + (row_id + 2) % 5 - 2 as int))")
    return walk.select(F.concat(F.lit("SYN"), F.col("s")).alias("symbol"), "row_id", day.cast("timestamp_ntz").alias("date"), "open", (F.greatest("open", "close") * span).alias("high"), (F.least("open", "close") / span).alias("low"), "close", F.floor(800 + 400 * unit("d")).cast("double").alias("volume"))


def bars_orders(orders: DataFrame) -> DataFrame:
    """One daily series from orders: first and last price by order key, extremes, and the count as volume."""
    day = F.to_date("o_orderdate")
    price = F.col("o_totalprice")
    bars = orders.where("o_orderdate is not null").groupBy(day.cast("timestamp_ntz").alias("date")).agg(F.min_by(price, "o_orderkey").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))
    return canonical(bars, "ORDERS")


def bars_panel(lineitem: DataFrame, by: str = "l_returnflag") -> DataFrame:
    """Daily series of unit prices for each value of ``by``; ties in the order keys are broken by every other column."""
    keys = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lineitem.where("l_shipdate is not null and l_quantity > 0").select(F.col(by).cast("string").alias("symbol"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("date"), keys.alias("k"), price.alias("p"), "l_quantity")
    bars = rows.where("symbol is not null").groupBy("symbol", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"))
    return canonical(bars)


def violations(bars: DataFrame) -> DataFrame:
    """One row: how many rows break each rule of a bar table."""
    broken = lambda c: F.isnull(c) | F.isnan(c) | (F.abs(c) == float("inf"))
    prices = [F.col(c) for c in PRICES]
    any_of = lambda cs: F.array_contains(F.array(*cs), True)
    tagged = bars.withColumn("copies", F.count("*").over(Window.partitionBy("symbol", "date")))
    return tagged.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("date").isNull()).alias("bad_dates"),
        F.count_if(F.col("date").isNotNull() & (F.col("copies") > 1)).alias("duplicate_dates"),
        F.count_if(any_of([broken(F.col(c)) for c in [*PRICES, "volume"]])).alias("non_finite"),
        F.count_if(any_of([c <= 0 for c in prices])).alias("non_positive"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))).alias("bad_range"),
    )


def validate(bars: DataFrame, least: int = 700) -> DataFrame:
    """``bars``, if no rule is broken."""
    found = violations(bars).collect()[0].asDict()
    if found["n_rows"] < least:
        raise ContractError(f"{found['n_rows']} rows, {least} wanted")
    if bad := {k: v for k, v in found.items() if k != "n_rows" and v}:
        raise ContractError(f"broken rules: {bad}")
    return bars


def normalize(raw: DataFrame, volume: str | None = None, least: int = 700, symbol: str = "ONE") -> DataFrame:
    """Validated bars of a raw table.

    Tick and real volume are never mixed: where both are there, ``volume`` must choose.  Rows must come in
    ascending order of date, which is told for a table read from a single file.
    """
    if volume is None and {"tick_volume", "real_volume"} <= set(raw.columns):
        raise ContractError("two kinds of volume and no choice")
    chosen = select_volume(raw, volume) if volume else raw
    if missing := [c for c in REQUIRED if c not in chosen.columns]:
        raise ContractError(f"missing columns {missing}")
    typed = chosen.select(*[c for c in ("symbol",) if c in chosen.columns], F.col("date").cast("timestamp_ntz").alias("date"), *[F.col(c).try_cast("double").alias(c) for c in [*PRICES, "volume"]])
    at = typed.withColumn("__at", F.monotonically_increasing_id())
    w = Window.partitionBy(*(["symbol"] if "symbol" in typed.columns else [F.lit(1)])).orderBy("__at")
    if at.withColumn("__before", F.lag("date").over(w)).where(F.col("date") < F.col("__before")).limit(1).count():
        raise ContractError("rows are not in order")
    return validate(canonical(typed, symbol), least)


def downloaded(raw: DataFrame, first: str, last: str, volume: str, symbol: str = "ONE") -> tuple[DataFrame, dict]:
    """Bars of a download between two dates without the newest, which may still change, and a manifest of them."""
    kept = raw.where((F.col("date") >= F.lit(first).cast("timestamp_ntz")) & (F.col("date") <= F.lit(last).cast("timestamp_ntz")))
    bars = canonical(select_volume(kept, volume), symbol)
    bars = drop_newest(bars)
    n, a, b = bars.agg(F.count("*"), F.min("date"), F.max("date")).collect()[0]
    return bars, {"symbol": symbol, "volume": volume, "rows": n, "first": str(a), "last": str(b), "requested": [first, last], "newest_dropped": True}


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """One row: keys that only one side has, and for each column how many values differ by more than ``tolerance``."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(1).alias("l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("r"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    apart = lambda c: both & ~F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= tolerance, F.col(f"l_{c}").isNull() & F.col(f"r_{c}").isNull())
    return a.join(b, keys, "full_outer").agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), *[F.count_if(apart(c)).alias(c) for c in columns])


def fingerprint(df: DataFrame, columns: list[str], scale: float = 1e4) -> DataFrame:
    """One row (n, digest): the sum of a hash of every row of numbers, scaled to integers, in any order."""
    text = F.concat_ws("|", *[F.coalesce(F.round(F.col(c) * scale).cast("long").cast("string"), F.lit("-")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(part).alias("digest"))


def drop_newest(bars: DataFrame) -> DataFrame:
    """Without the newest bar of each symbol, which may still change."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def development_prefix(bars: DataFrame, boundary, n: int) -> DataFrame:
    """The first ``n`` rows of each symbol, which must have so many; all must lie before ``boundary``."""
    part = bars.where(F.col("row_id") < n)
    if part.groupBy("symbol").count().where(F.col("count") != n).limit(1).count():
        raise ContractError(f"a symbol has fewer than {n} rows")
    if part.where(F.col("date") >= F.lit(boundary).cast("timestamp_ntz")).limit(1).count():
        raise ContractError("the prefix reaches the boundary")
    return part


def signal_violations(signals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Breaches of the signal contract, one row for each of ``keys``; ids are counted before they are joined back."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("entry_time", "signal_id")
    ids = signals.groupBy(*keys, "signal_id").agg(F.count("*").alias("n"))
    s = signals.withColumn("before", F.lag("entry_time").over(w)).join(ids, [*keys, "signal_id"])
    return s.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col("entry_time") <= F.col("before")).alias("entry_not_after"), F.count_if(F.col("exit_time") <= F.col("entry_time")).alias("exit_not_after"), F.count_if(~F.col("direction").isin(-1, 1)).alias("bad_direction"), F.count_if(F.col("n") > 1).alias("repeated_id"))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """A frozen signal table; its columns, their order and its rows must keep the contract."""
    raw = spark.read.option("header", True).csv(path)
    if raw.columns != SIGNAL_COLUMNS:
        raise ContractError(f"columns are {raw.columns}")
    time = lambda c: F.to_timestamp_ntz(c, F.lit("yyyy.MM.dd HH:mm")).alias(c)
    signals = raw.select(time("entry_time"), time("exit_time"), F.col("direction").try_cast("int").alias("direction"), "signal_id")
    found = signal_violations(signals).collect()
    if found and (bad := {k: v for k, v in found[0].asDict().items() if k != "n_rows" and v}):
        raise ContractError(f"broken rules: {bad}")
    return signals


def parse_report(spark: SparkSession, path: str, labels: list[str], encoding: str = "UTF-16") -> DataFrame:
    """One row of the labelled values in a tester's HTML report."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("html"))
    plain = raw.select(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", "\u0001"), "(&nbsp;|[\u0001\\s])+", " ").alias("t"))
    return plain.select(*[F.nullif(F.regexp_extract("t", rf"{label}:\s*(\S+(?: \([^)]*\))?)", 1), F.lit("")).alias(label) for label in labels])


# --- physical partitions ----------------------------------------------------


def sha256_file(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def dataset_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of the names and hashes of a dataset's files, which executors hash; any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    return hashlib.sha256("\n".join(f"{r.name}:{r.sha}" for r in files.orderBy("name").collect()).encode()).hexdigest()  # a row for each file


def freeze_partitions(bars: DataFrame, boundary: str, folder: str) -> dict:
    """Write the rows before and from ``boundary`` as two datasets that never change; returns their summary.

    Each is written aside and renamed when its rows are counted, so that half a partition is never found.
    """
    at = F.lit(boundary).cast("timestamp_ntz")
    spark, out = bars.sparkSession, {}
    for role, part in (("development", bars.where(F.col("date") < at)), ("audit", bars.where(F.col("date") >= at))):
        aside = f"{folder}/.{role}-{uuid.uuid4().hex}"
        part.write.parquet(aside)
        n, first, last = spark.read.parquet(aside).agg(F.count("*"), F.min("date"), F.max("date")).collect()[0]
        rename(spark, aside, f"{folder}/{role}")
        out[role] = {"role": role, "rows": n, "first": str(first), "last": str(last), "boundary": boundary, "sha256": dataset_sha256(spark, f"{folder}/{role}")}
    total = bars.count()
    if sum(x["rows"] for x in out.values()) != total:
        raise ContractError("the partitions don't add up")
    return out


def load_development(spark: SparkSession, folder: str, summary: dict, least: int = 1) -> DataFrame:
    """The development partition, if its files and rows are what its summary says; the audit partition can't be read here."""
    if summary.get("role") != "development":
        raise ContractError("only the development partition may be read")
    if dataset_sha256(spark, f"{folder}/development") != summary["sha256"]:
        raise ContractError("the partition's files have changed")
    df = spark.read.parquet(f"{folder}/development")
    n, last = df.agg(F.count("*"), F.max("date")).collect()[0]
    if n != summary["rows"] or n < least or str(last) >= summary["boundary"]:
        raise ContractError("the partition isn't the one that was frozen")
    return df


def load_sidecar(path: str | Path, folder: str | Path) -> dict:
    """A JSON manifest with exactly one entry (path, sha256) for each file of ``folder``; all hashes must hold."""
    payload = json.loads(Path(path).read_text())
    names = [e["path"] for e in payload["files"]]
    there = sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())
    if sorted(names) != there:
        raise ContractError("the manifest doesn't list each file once")
    if bad := [e["path"] for e in payload["files"] if sha256_file(Path(folder) / e["path"]) != e["sha256"]]:
        raise ContractError(f"changed files {bad}")
    return payload


# --- sinks -------------------------------------------------------------------


def write_json(path: str | Path, payload, exclusive: bool = False) -> None:
    """Canonical JSON; written aside and renamed, or never over an existing file."""
    text = json.dumps(payload, sort_keys=True, indent=2, allow_nan=False)
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    if exclusive:
        with path.open("x") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        return
    aside = path.with_suffix(path.suffix + ".tmp")
    aside.write_text(text)
    aside.replace(path)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder or file of any store; never over an existing one."""
    jvm = spark._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        raise ContractError(f"{new} can't be made")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file, written aside and renamed; for tables of reports, which one task holds."""
    spark, aside = df.sparkSession, f"{path}.tmp-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(aside)
    where = spark._jvm.org.apache.hadoop.fs.Path(aside)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))
    rename(spark, part, path)
    fs.delete(where, True)


def write_signals(signals: DataFrame, folder: str) -> None:
    """Signal tables by horizon."""
    signals.write.mode("errorifexists").partitionBy("horizon").option("header", True).csv(folder)
