"""Point-in-time join: each decision gets the latest source row available at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bars import ContractError


def backward_asof(decisions: DataFrame, source: DataFrame, features: list[str], *, on: str = "decision_timestamp", observed: str = "observed_at", available: str = "available_at", by: list[str] = (), max_staleness_seconds: float | None = None, prefix: str = "", check: bool = True) -> DataFrame:
    """``decisions`` with ``features`` and audit columns, by one union and one window: no range join.

    The whole latest row counts, nulls included.  A match older than ``max_staleness_seconds`` keeps its
    times and loses its values.  A key's rows are one sorted run, read once; without a key a day's are.
    """
    by = list(by)
    for df, c in ((decisions, on), (source, observed), (source, available)):
        if not isinstance(df.schema[c].dataType, T.TimestampType):
            raise ContractError(f"{c} has no time zone")
    if max_staleness_seconds is not None and max_staleness_seconds <= 0:
        raise ContractError("staleness must be positive")
    added = [prefix + c for c in (*features, "source_observed_at", "source_available_at", "staleness_seconds", "availability_matched", "is_stale", "feature_coverage")]
    if clash := set(added) & set(decisions.columns):
        raise ContractError(f"columns exist already: {sorted(clash)}")
    if check:
        w = Window.partitionBy(*by, available) if by else Window.partitionBy(available)
        bad = source.withColumn("__n", F.count("*").over(w)).agg(F.count_if(F.col(observed) > F.col(available)), F.count_if(F.col("__n") > 1)).collect()[0]
        if bad[0] or bad[1]:
            raise ContractError(f"{bad[0]} rows are available before they are observed, {bad[1]} share a time")
    packed = F.struct(F.col(observed).alias("__o"), F.col(available).alias("__a"), *[F.col(f) for f in features])
    right = source.select(*by, F.col(available).alias("__t"), F.lit(0).alias("__side"), packed.alias("__row"))
    left = decisions.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), F.struct(*decisions.columns).alias("__decision"))
    both = right.unionByName(left, allowMissingColumns=True)
    if not by:  # without a key each day is a run of its own, and a table of the days carries the last row on
        both = both.withColumn("__day", F.date_trunc("day", "__t"))
        days = both.groupBy("__day").agg(F.max_by("__row", F.when(F.col("__side") == 0, F.col("__t"))).alias("__of_day"))
        carried = days.withColumn("__before", F.last("__of_day", ignorenulls=True).over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).drop("__of_day")
    run = Window.partitionBy(*(by or ["__day"])).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("__hit", F.last("__row", ignorenulls=True).over(run)).where("__side = 1")
    if not by:
        hit = hit.join(F.broadcast(carried), "__day").withColumn("__hit", F.coalesce("__hit", "__before"))  # a row for each day
    age = F.col("__t").cast("double") - F.col("__hit.__a").cast("double")
    stale = F.coalesce(age > max_staleness_seconds, F.lit(False)) if max_staleness_seconds is not None else F.lit(False)
    usable = F.col("__hit").isNotNull() & ~stale
    values = {f: F.when(usable, F.col(f"__hit.{f}")) for f in features}
    held = sum((v.isNotNull().cast("int") for v in list(values.values())[1:]), next(iter(values.values())).isNotNull().cast("int"))
    return hit.select(
        "__decision.*", *[v.alias(prefix + f) for f, v in values.items()],
        F.col("__hit.__o").alias(prefix + "source_observed_at"), F.col("__hit.__a").alias(prefix + "source_available_at"), age.alias(prefix + "staleness_seconds"),
        F.col("__hit").isNotNull().alias(prefix + "availability_matched"), stale.alias(prefix + "is_stale"), (held / float(len(features))).alias(prefix + "feature_coverage"),
    )
