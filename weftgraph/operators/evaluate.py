"""Retrieval quality: ranked metrics, slices, percentiles, confusion, bootstrap, strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(results: DataFrame, judgments: DataFrame, cutoffs: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """results (query_id, id, rank) against judgments (query_id, id, grade; below 0 a hard negative).

    Each judgment counts once, at the first place of its id. Per query: hit@k, reciprocal rank, nDCG (at most 1) and whether
    a hard negative comes before anything relevant.
    """
    once = results.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    j = once.join(judgments, ["query_id", "id"])
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = j.groupBy("query_id").agg(
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_relevant"), F.min(F.when(F.col("grade") < 0, F.col("rank"))).alias("first_hard_negative"), F.sum(F.when(F.col("grade") > 0, gain)).alias("dcg")
    )
    ideal = judgments.where("grade > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    best = ideal.join(n, "query_id").where("place <= n").groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)).alias("ideal"))
    all_ = n.join(got, "query_id", "left").join(best, "query_id", "left")
    hits = [F.coalesce((F.col("first_relevant") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in cutoffs]
    ndcg = F.coalesce(F.least(F.lit(1.0), F.col("dcg") / F.col("ideal")), F.lit(0.0))
    before = F.col("first_hard_negative").isNotNull() & (F.col("first_relevant").isNull() | (F.col("first_hard_negative") < F.col("first_relevant")))
    return all_.select("query_id", *hits, F.coalesce(1 / F.col("first_relevant"), F.lit(0.0)).alias("mrr"), ndcg.alias("ndcg"), before.cast("int").alias("hard_negative_first"))


def slices(metrics: DataFrame, dims: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Means by each dimension by itself, all in one pass of grouping sets: (dimension, value, queries, means)."""
    name = F.coalesce(*[F.when(F.grouping(d) == 0, d) for d in dims])
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dims])
    return metrics.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(name.alias("dimension"), value.alias("value"), F.count("*").alias("queries"), *[F.avg(v).alias(v) for v in values]).select("dimension", "value", "queries", *values)


def macro_micro(metrics: DataFrame, group: str, value: str) -> DataFrame:
    """Mean over all queries, and mean of the groups' means."""
    per = metrics.groupBy(group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return per.agg((F.sum("s") / F.sum("n")).alias("micro"), F.avg("m").alias("macro"))


def percentiles(df: DataFrame, value: str, by: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(by, *wanted): elements of each group's sorted values by (fraction, rule), null values passed over.

    rule: ceil, floor, round, or capped (never the last of fewer than 20). Equal values are counted before they are
    shuffled, and places are running sums over the distinct ones, so no group is gathered into an array.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(by)
    upto = counts.withColumn("__upto", F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    sizes = counts.groupBy(by).agg(F.sum("__c").alias("__n"))
    n = F.col("__n")
    places = {
        "ceil": lambda p: F.ceil(F.lit(p) * n) - 1,
        "floor": lambda p: F.floor(F.lit(p) * (n - 1)),
        "round": lambda p: F.round(F.lit(p) * (n - 1)),
        "capped": lambda p: F.least(n - 1, F.ceil(F.lit(p) * n)) - 1,
    }
    at = lambda p, rule: F.greatest(places[rule](p), F.lit(0))
    return upto.join(sizes, by).groupBy(by).agg(*[F.min(F.when(F.col("__upto") > at(p, rule), F.col("__v"))).alias(name) for name, (p, rule) in wanted.items()])


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median, 95th percentile (the value at rank ceil(p n)) and maximum."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max(value).alias("max"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n, share of the label)."""
    n = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def bootstrap(values: DataFrame, column: str, rounds: int = 2000, seed: int = 20260805) -> DataFrame:
    """(low, high): 95 % interval of the mean, by ``rounds`` samples of as many values as there are, drawn with replacement.

    values: (key, column), a set of measured questions; nulls are passed over. A draw is a hash of seed, round and place,
    so it doesn't depend on partitions. No values: both are null.
    """
    v = values.where(F.col(column).isNotNull())
    v = v.select(F.col(column).alias("v"), (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("at"))
    n = v.count()
    draw = F.concat_ws(":", F.lit(str(seed)), F.expr(f"id div {max(n, 1)}"), F.expr(f"id % {max(n, 1)}"))
    picked = F.conv(F.substring(F.md5(draw.cast("binary")), 1, 12), 16, 10).cast("long") % max(n, 1)
    draws = values.sparkSession.range(rounds * n).select(F.expr(f"id div {max(n, 1)}").alias("round"), picked.alias("at"))
    means = draws.join(v, "at").groupBy("round").agg(F.avg("v").alias("m"))
    at = lambda p: F.element_at(F.array_sort(F.collect_list("m")), int(p * (rounds - 1)) + 1)  # noqa: E731  (rounds of them)
    if not n:
        return means.agg(F.max("m").alias("low"), F.max("m").alias("high"))
    return means.agg(at(0.025).alias("low"), at(0.975).alias("high"))


def round_robin(df: DataFrame, stratum: str, key: str, limit: int) -> DataFrame:
    """A stratified sample: the first of each stratum, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(key)).cast("long")
    return df.withColumn("turn", turn).orderBy("turn", stratum).limit(limit)


def aggregate_mode(results: DataFrame, metrics: list[str], group: str = "repository", dims: tuple[str, ...] = ("split",)) -> DataFrame:
    """(scope, value, queries, *metrics) of the results of one mode: means over all questions (query-weighted), over each
    group and dimension, and the mean of the groups' means (macro). Null metrics are passed over; without rows, no rows.

    The results are read once, into sums by group and dimensions; every scope is made from those.
    """
    base = results.groupBy(group, *dims).agg(F.count("*").alias("__q"), *[f(F.col(m)).alias(f"__{k}_{m}") for m in metrics for k, f in (("s", F.sum), ("n", F.count))])
    whole = [F.sum("__q").alias("queries"), *[(F.sum(f"__s_{m}") / F.sum(f"__n_{m}")).alias(m) for m in metrics]]
    shape = ["scope", "value", "queries", *metrics]

    def of(scope: str, df: DataFrame, value: Column) -> DataFrame:
        return df.withColumn("scope", F.lit(scope)).withColumn("value", value).where("queries > 0").select(*shape)

    per = base.groupBy(group).agg(*whole)
    macro = per.agg(F.sum("queries").alias("queries"), *[F.avg(m).alias(m) for m in metrics])
    parts = [of("query-weighted", base.agg(*whole), F.lit("")), of("macro", macro, F.lit("")), of(group, per, F.col(group).cast("string"))]
    parts += [of(d, base.groupBy(d).agg(*whole), F.col(d).cast("string")) for d in dims]
    return reduce(DataFrame.unionByName, parts)


def stage_shares(samples: DataFrame, stages: list[str], *by: str) -> DataFrame:
    """Each stage's share of the time of all stages, in percent; null is 0, and where there is no time all are 0."""
    sums = samples.groupBy(*by).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in stages])
    total = reduce(Column.__add__, [F.col(s) for s in stages])
    return sums.select(*by, *[F.when(total == 0, 0.0).otherwise(100.0 * F.col(s) / F.nullif(total, F.lit(0))).alias(s) for s in stages])
