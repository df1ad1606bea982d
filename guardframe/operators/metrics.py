"""Counters, histograms and quantiles over requests and deliveries.

Counts and sums are partial on the map side, so a hot key costs a row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_metrics(df: DataFrame, *by: str) -> DataFrame:
    """Per key: requests, policy hits, and for each kind of duration above zero its count, sum, least and greatest.

    Input columns: hits (how many), duration_ms, upstream_ms, inference_ms.
    """
    out = [F.count("*").alias("requests"), F.sum(F.when(F.col("hits") > 0, F.col("hits"))).alias("policy_hits")]
    for name in ("duration", "upstream", "inference"):
        value = F.col(f"{name}_ms")
        kept = value if name == "duration" else F.when(value > 0, value)
        out += [F.count(kept).alias(f"{name}_n"), F.sum(kept).alias(f"{name}_sum"), F.min(kept).alias(f"{name}_least"), F.max(kept).alias(f"{name}_most")]
    return df.groupBy(*by).agg(*out)


def bucket(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound that the value doesn't exceed; their number beyond the last."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], i).otherwise(out)
    return out


#: Values of a group among which a rank is found by a window, and ranges into which more are divided.
MOST, RANGES = 100_000, 1024


def nearest_rank(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str], most: int = MOST) -> DataFrame:
    """Per group the average, and for each share the value at index int(n * share) of the
    sorted values, from 0. A group without values has no row.

    No group is gathered: while a searched range holds more than ``most`` values, it is
    divided into ranges that are counted with partial sums, and the search goes on
    in the one that holds the rank. The driver gets one number a round.
    """
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    groups = own.groupBy(*by).agg(F.avg("__v").alias("avg"), F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("__share"), F.floor(F.col("__n") * s).alias("__at")) for i, s in enumerate(shares))))
    state = groups.select(*by, "__n", "__low", "__high", wanted.alias("__w")).select(*by, "__w.*", "__n", "__low", "__high")
    keys = [*by, "__share"]

    def inside() -> DataFrame:
        return own.join(state, list(by)).where(F.col("__v").between(F.col("__low"), F.col("__high")))

    def holding(rows: DataFrame, order: str) -> DataFrame:
        """Of counted ranges (or values) in their order, the one that holds the rank."""
        upto = F.sum("__count").over(Window.partitionBy(*keys).orderBy(order)) - F.col("__count")
        return rows.withColumn("__before", upto).where((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__count")))

    while (state.where("__low < __high").agg(F.max("__n")).first()[0] or 0) > most:
        place = F.least(F.floor((F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low")) * RANGES), F.lit(RANGES - 1))
        ranges = inside().groupBy(*keys, "__at", F.when(F.col("__low") < F.col("__high"), place).otherwise(0).alias("__range"))
        counted = ranges.agg(F.count("*").alias("__count"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        state = holding(counted, "__range").select(*keys, (F.col("__at") - F.col("__before")).alias("__at"), F.col("__count").alias("__n"), "__low", "__high")
    found = holding(inside().groupBy(*keys, "__at", "__v").agg(F.count("*").alias("__count")), "__v")
    quantiles = found.groupBy(*by).agg(*(F.max(F.when(F.col("__share") == i, F.col("__v"))).alias(f"p{round(s * 100)}") for i, s in enumerate(shares)))
    return groups.select(*by, "avg").join(quantiles, list(by))


def delivery_counters(df: DataFrame, outcome: str, sink: str) -> DataFrame:
    """Per sink how many events were delivered and how many failed."""
    return df.groupBy(sink).agg(F.count("*").alias("enqueued"), F.count_if(F.col(outcome) == "ok").alias("delivered"), F.count_if(F.col(outcome) == "failed").alias("failed"), F.count_if(F.col(outcome) == "dropped").alias("dropped"))
