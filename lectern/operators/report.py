"""Benchmark percentiles and the regression report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows up to which what is left of the samples is ranked at once, and ranges into which more are cut.
FEW, RANGES = 1_000_000, 200


def order_statistics(samples: DataFrame, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """The rows of ``wanted`` (name, rank from 1, more columns) with ``value``, that of ``samples`` (name, value) at the rank, exactly.

    Samples are cut into ranges by approximate quantiles, ranges are counted, and only those in which an asked rank lies
    are cut again, until they are small; then equal values are counted together and ranked inside their range. No
    name is held or sorted by one task.
    """
    rows = samples.where("value is not null").select("name", F.lit(0).cast("long").alias("part"), F.col("value").cast("double").alias("value"))
    kept = wanted.columns
    asked = wanted.select(*kept, F.lit(0).cast("long").alias("part"), F.col("rank").cast("long").alias("left"))
    for _ in range(6):
        sizes = rows.groupBy("name", "part").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
        large = sizes.agg(F.max(F.when(F.col("low") < F.col("high"), F.col("c")))).first()[0]
        if large is None or large <= few:
            break
        cuts = [k / RANGES for k in range(1, RANGES)]
        bounds = rows.groupBy("name", "part").agg(F.percentile_approx("value", cuts, 10_000).alias("bounds"))
        # a value that is a bound is a range of its own, however often it occurs
        below = F.size(F.filter("bounds", lambda b: b < F.col("value"))) + F.size(F.filter("bounds", lambda b: b <= F.col("value")))
        cut = rows.join(bounds, ["name", "part"]).select("name", "part", (F.col("part") * 2 * RANGES + below).alias("sub"), "value")
        before = F.sum("c").over(Window.partitionBy("name", "part").orderBy("sub")) - F.col("c")
        counts = cut.groupBy("name", "part", "sub").agg(F.count(F.lit(1)).alias("c")).withColumn("before", before)
        asked = asked.join(counts, ["name", "part"]).where((F.col("left") > F.col("before")) & (F.col("left") <= F.col("before") + F.col("c")))
        asked = asked.select(*kept, F.col("sub").alias("part"), (F.col("left") - F.col("before")).alias("left")).persist()
        rows = cut.select("name", F.col("sub").alias("part"), "value").join(asked.select("name", "part").distinct(), ["name", "part"], "left_semi").persist()  # a small part of the samples, read several times
    per = rows.groupBy("name", "part", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("name", "part").orderBy("value"))
    per = per.withColumn("upto", upto)
    return asked.join(per, ["name", "part"]).where((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("c"))).select(*kept, "value")


def percentiles(samples: DataFrame, by: str = "name", value: str = "ms", exact: bool = False, few: int = FEW) -> DataFrame:
    """(name, p50_ms, p95_ms): exact ones between the two nearest ranks, by selection; the others from bounded sketches."""
    if not exact:
        pick = F.percentile_approx(value, [0.5, 0.95], 100_000)
        return samples.groupBy(F.col(by).alias("name")).agg(pick.alias("p")).select("name", F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p95_ms"))
    named = samples.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("name"), F.col(value).alias("value"))
    sizes = named.where("value is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    places = F.array(*[F.struct(F.lit(q).alias("q"), ((F.col("n") - 1) * q).alias("at")) for q in (0.5, 0.95)])
    places = sizes.select("name", F.inline(places)).select("name", "q", (F.col("at") - F.floor("at")).alias("part_of"), (F.floor("at") + 1).alias("low"), (F.ceil("at") + 1).alias("high"))
    found = order_statistics(named, places.select("name", "q", "part_of", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank")), few)

    def between(q: float, name: str) -> Column:
        of = lambda c: F.when(F.col("q") == q, F.col(c))
        low, high = F.min(of("value")), F.max(of("value"))
        return (low + (high - low) * F.max(of("part_of"))).alias(name)

    return found.groupBy("name").agg(between(0.5, "p50_ms"), between(0.95, "p95_ms"))


def regression_report(baseline: DataFrame, current: DataFrame, threshold: float = 15.0) -> DataFrame:
    """(name, baseline_p95, current_p95, delta_percent, verdict): REGRESS above the threshold, skip without a current value."""
    both = baseline.select("name", F.col("p95_ms").alias("baseline_p95")).join(current.select("name", F.col("p95_ms").alias("current_p95")), "name", "left")
    delta = (F.col("current_p95") - F.col("baseline_p95")) / F.col("baseline_p95") * 100
    verdict = F.when(F.col("current_p95").isNull(), "skip").when(delta > threshold, "REGRESS").otherwise("ok")
    return both.withColumn("delta_percent", delta).withColumn("verdict", verdict)


def gate_failed(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or(F.col("verdict") == "REGRESS"), F.lit(False)).alias("failed"))
