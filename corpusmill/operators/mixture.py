"""Mixtures: rates, sparse designs, weighted draws, epochs, coverage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.scalar import uniform
from corpusmill.operators.corpus import numbered


def rates(sources: DataFrame) -> DataFrame:
    """Adds ``rate``: the root of a source's size (at least 1), normalised within its group, times the group's weight, normalised
    over all.  ``sources``: (grp, grp_weight, source, size)."""
    root = F.sqrt(F.greatest(F.col("size").cast("double"), F.lit(1.0)))
    inside = root / F.sum(root).over(Window.partitionBy("grp")) * F.col("grp_weight")
    rows = sources.withColumn("_r", inside)
    return rows.withColumn("rate", F.col("_r") / F.sum("_r").over(Window.partitionBy(F.lit(0)))).drop("_r")


def renormalise(weights: DataFrame, present: DataFrame, key: str, weight: str = "w") -> DataFrame:
    """Weights of the keys that are present, made to sum to 1, and the share of weight they had."""
    w = weights.filter(F.col(weight) > 0)
    total = w.agg(F.sum(weight).alias("_all"))
    kept = w.join(present.select(key).distinct(), key, "left_semi")
    sums = F.sum(weight).over(Window.partitionBy(F.lit(0)))
    return kept.withColumn("rate", F.col(weight) / sums).withColumn("_sum", sums).join(F.broadcast(total)).withColumn("coverage", F.col("_sum") / F.col("_all")).drop("_sum", "_all")  # one row


def coverage_by_run(weights: DataFrame, present: DataFrame, least: float, run: str = "run_id", key: str = "pool") -> DataFrame:
    """(run, coverage) of runs that keep at least ``least`` of their weight on the pools at hand."""
    w = weights.filter(F.col("w") > 0)
    there = w.join(present.select(key, F.lit(1).alias("_there")).distinct(), key, "left")
    out = there.groupBy(run).agg((F.sum(F.when(F.col("_there") == 1, F.col("w"))) / F.sum("w")).alias("coverage"))
    return out.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).filter(F.col("coverage") >= least)


#: Cells of the unit interval.
CELLS = 4096


def weighted_draws(steps: DataFrame, rated: DataFrame, key: str, seed: int, step: str = "step") -> DataFrame:
    """(step, key): one draw a step, by the inverse of the cumulative rates; the same for the same seed.

    The unit interval is cut into cells; a source's share of it is a row for each cell that it touches, and a step meets its cell's rows by
    an equi-join, however many sources there are."""
    line = Window.partitionBy(F.lit(0)).orderBy(key)  # a row for each source
    bounds = rated.select(key, F.sum("rate").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("_high"), F.lead(F.lit(1)).over(line).isNull().alias("_last"))
    bounds = bounds.withColumn("_low", F.coalesce(F.lag("_high").over(line), F.lit(0.0))).withColumn("_high", F.when(F.col("_last"), F.lit(float("inf"))).otherwise(F.col("_high")))
    cells = bounds.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") * CELLS), F.floor(F.least(F.col("_high"), F.lit(1.0)) * CELLS)))).filter("_low < _high")
    rows = steps.withColumn("_u", uniform(F.lit(str(seed)), F.col(step))).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    return rows.join(cells, "_cell").filter((F.col("_low") <= F.col("_u")) & (F.col("_u") < F.col("_high"))).select(*steps.columns, key)


def epochs(examples: DataFrame, draws: DataFrame, source: str, key: str, seed: int, step: str = "step") -> DataFrame:
    """(step, source, key): each draw of a source takes the next example of its current permutation; when a source is exhausted, it is
    permuted anew.  The k-th draw of a source with n examples is example k mod n of epoch k div n."""
    sizes = examples.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    wanted = numbered(draws, step, "_k", source).join(sizes, source).withColumns({"_epoch": F.floor(F.col("_k") / F.col("_n")), "_i": F.pmod("_k", F.col("_n"))})
    needed = wanted.select(source, "_epoch").distinct()
    shuffle = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_epoch").cast("string"), F.col(key).cast("string")))
    permuted = examples.select(source, key).join(needed, source).withColumn("_md5", shuffle).withColumn("_place", F.conv(F.substring("_md5", 1, 15), 16, 10).cast("bigint"))
    permuted = numbered(permuted, "_place", "_i", [source, "_epoch"], ("_md5", key), most=1 << 60).drop("_md5", "_place")
    return wanted.join(permuted, [source, "_epoch", "_i"]).select(step, source, key)


def runs_with_weights(runs: DataFrame, weights: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds ``weights``, a map from pool to weight; a run that has none has an empty map."""
    maps = weights.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pool", "w")))).alias("weights"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return runs.join(maps, run, "left").withColumn("weights", F.coalesce("weights", empty))


def collect_results(results: DataFrame, pools: DataFrame, metrics: list[str], groups: list[str], run: str = "run_id") -> DataFrame:
    """One row for each result: its metrics, and the weight of each group (5 digits) as w_<group>.

    ``results``: (run, weights, metrics); ``pools``: (pool, grp).  A result without weights has 0 everywhere."""
    own = results.select(run, F.explode("weights").alias("pool", "w"))
    sums = group_weights(own, pools, groups, run)
    columns = (F.coalesce(F.col(g), F.lit(0.0)).alias(f"w_{g}") for g in groups)
    return results.select(run, *metrics).join(sums, run, "left").select(run, *metrics, *columns)


def sparse_designs(spark: SparkSession, names: list[str], groups: list[str], n: int, seed: int, smallest: int = 2) -> DataFrame:
    """(run_id, kind, pool, w): uniform and one-group baselines, then ``n`` Dirichlet weights over random subsets of pools.

    A flat Dirichlet draw is a row of exponential draws over their sum; all draws are hashes of the seed, the run and the pool."""
    runs = [("uniform", "uniform")] + [(f"group_{g}", "group") for g in sorted(set(groups))] + [(f"mix_{i:04d}", "sparse") for i in range(n)]
    pools = F.from_json(F.lit(json.dumps([{"pool": p, "grp": g} for p, g in zip(names, groups, strict=True)])), "array<struct<pool: string, grp: string>>")
    cells = spark.createDataFrame(runs, "run_id string, kind string").select("run_id", "kind", F.inline(pools))
    least = min(smallest, len(names))
    draw = lambda what, *of: uniform(F.lit(seed), F.lit(what), "run_id", *of)
    of_run = Window.partitionBy("run_id")
    place = F.row_number().over(of_run.orderBy(draw("place", "pool"), "pool"))
    picked = place <= least + F.floor(draw("size") * (len(names) + 1 - least))
    part = F.when(F.col("kind") == "uniform", 1.0).when(F.col("kind") == "group", (F.col("run_id") == F.concat(F.lit("group_"), "grp")).cast("double"))
    part = part.otherwise(F.when(picked, -F.log(1 - draw("weight", "pool"))).otherwise(0.0))
    shares = cells.withColumn("_part", part).withColumn("w", F.col("_part") / F.sum("_part").over(of_run))
    return shares.filter("w > 0").select("run_id", "kind", "pool", "w")


def support_summary(weights: DataFrame, run: str = "run_id") -> DataFrame:
    """Smallest, median (floored) and largest number of pools in a run."""
    sizes = weights.filter("w > 0").groupBy(run).agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.min("k").alias("smallest"), F.floor(F.percentile("k", F.lit(0.5))).alias("median"), F.max("k").alias("largest"))


def pending_runs(runs: DataFrame, results: DataFrame, i: int = 0, n: int = 1, run: str = "run_id") -> DataFrame:
    """The i-th of n slices of runs, without those that have a result."""
    from corpusmill.operators.corpus import every_nth

    return every_nth(runs, run, i, n).join(results.select(run).distinct(), run, "left_anti")


def status(runs: DataFrame, results: DataFrame, run: str = "run_id") -> DataFrame:
    done = results.select(run, F.lit(1).alias("_d")).distinct()
    return runs.join(done, run, "left").agg(F.count(F.lit(1)).alias("runs"), F.count("_d").alias("done"), (F.count(F.lit(1)) - F.count("_d")).alias("left"))


def group_weights(weights: DataFrame, pools: DataFrame, groups: list[str] | None = None, run: str = "run_id") -> DataFrame:
    """One row for each run with the summed weight of each group (5 digits); pools nobody knows are in the group "?"."""
    known = weights.join(pools.select("pool", "grp"), "pool", "left").withColumn("grp", F.coalesce("grp", F.lit("?")))
    return known.groupBy(run).pivot("grp", groups).agg(F.round(F.sum("w"), 5)).fillna(0.0)


def top_runs(results: DataFrame, metric: str, k: int = 8, run: str = "run_id") -> DataFrame:
    """The k runs with the lowest finite metric."""
    return results.filter(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf"))).orderBy(metric, run).limit(k)


def top_groups(by_group: DataFrame, k: int = 3, run: str = "run_id") -> DataFrame:
    """(run, rank, grp, w): the k heaviest groups of each run; ties go to the later name, zeros are out."""
    best = Window.partitionBy(run).orderBy(F.desc("w"), F.desc("grp"))
    return by_group.filter("w > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
