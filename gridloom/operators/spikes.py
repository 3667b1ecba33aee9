"""Spikes, stuck runs and impossible values per source (problem 5).

A robust AR(1) is fitted per source: values are standardised by the source's median and
interquartile range, phi comes from the median step between neighbours. Additive-outlier tests run until a pass flags nothing new, each against neighbours cleaned of all outliers so far; a
value whose neighbours stay at its level is a level shift, not an outlier, so a run of 6 or more
readings at one level is ordinary and one of up to 5 is not. What the tests leave as ordinary fixes
the source's highest ordinary value, against which the exact rule decides.

No step gathers a source in one task: window work runs per (source, time shard), each shard with a
day of its neighbours as a halo, and what crosses shards afterwards is flagged rows, shard maxima and at most two boundary runs a shard, which are
joined across shards where a value goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timeline import floor_div, from_micros, stamp
from gridloom.operators.analytics import small
from gridloom.storage import materialize

DAY_US = 86_400_000_000
REACH = 5
FIRST_PASSES = 3


def _sharded(usable: DataFrame, shard_us: int) -> DataFrame:
    """The readings with the time shard they lie in."""
    return usable.select("household_id", floor_div(F.col("at_us"), shard_us).alias("shard"), "at_us", "kwh")


def _with_halo(src: DataFrame, shard_us: int, halo_us: int = DAY_US, only: DataFrame | None = None) -> DataFrame:
    """The readings, and as ``halo`` rows those within ``halo_us`` of a shard's end once more in the shard beyond it.

    One shuffle by (source, shard), which all that follows reads; of the shards in ``only``, if given.
    """
    at = F.col("at_us") - F.col("shard") * shard_us
    beyond = F.filter(F.array(F.lit(0), F.when(at < halo_us, F.lit(-1)), F.when(at >= shard_us - halo_us, F.lit(1))), lambda k: k.isNotNull())
    x = src.select("household_id", "shard", "at_us", "kwh", F.explode(beyond).alias("side"))
    x = x.select("household_id", (F.col("shard") + F.col("side")).alias("shard"), "at_us", "kwh", (F.col("side") != 0).alias("halo"))
    x = x if only is None else x.join(small(only), ["household_id", "shard"], "left_semi")
    return x.repartition("household_id", "shard")


def _fitted(base: DataFrame, least: int) -> DataFrame:
    """(household_id, shard, mid, unit, phi) of sources with ``least`` readings: level, scale and AR(1) of the whole source.

    Fitted robustly: the scale from the quartiles of the values, phi from how much smaller than
    theirs the spread of the steps between neighbours is (its square is 2 (1 - phi) of theirs under an
    AR(1)), by the median of the steps' sizes. Fits go to the readings by (source, shard), never by source alone.
    """
    v = F.col("kwh").cast("double")
    own = base.where(~F.col("halo")).select("household_id", "shard", v.alias("v"), F.abs(v - F.lag(v).over(Window.partitionBy("household_id", "shard").orderBy("at_us", "kwh"))).alias("step"))
    level = own.groupBy("household_id").agg(F.count("*").alias("total"), F.percentile_approx("v", [0.25, 0.5, 0.75], 2000).alias("q"), F.percentile_approx("step", 0.5, 2000).alias("step")).where(F.col("total") >= least)
    unit = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.abs(F.col("q")[1]) * 0.05, F.lit(1e-6))
    phi = 1 - F.pow(F.coalesce("step", F.lit(0.0)) / 0.6745 / unit, 2) / 2
    fit = level.select("household_id", F.col("q")[1].alias("mid"), unit.alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(0.95), phi)).alias("phi"))
    return own.select("household_id", "shard").distinct().join(fit, "household_id")


def _tested(base: DataFrame, fits: DataFrame, outlier: float, shift: int, passes: int) -> DataFrame:
    """Every usable reading of fitted sources, with its run, its outlier flag and whether the last pass set it.

    Neighbours over a shard's end are halo
    rows; beyond those a neighbour is taken to be at the source's median.
    """
    w = Window.partitionBy("household_id", "shard").orderBy("at_us", "kwh")
    x = base.join(fits, ["household_id", "shard"]).select(
        "household_id",
        "shard",
        "at_us",
        "kwh",
        "halo",
        "phi",
        F.col("kwh").cast("double").alias("v"),
        ((F.col("kwh").cast("double") - F.col("mid")) / F.col("unit")).alias("z"),
    )
    x = x.select(
        "*",
        F.coalesce(F.lag("z").over(w), F.lit(0.0)).alias("z0"),
        F.coalesce(F.lead("z").over(w), F.lit(0.0)).alias("z1"),
        # A shard's runs begin anew at its first own row.
        F.coalesce((F.lag("kwh").over(w) != F.col("kwh")) | F.lag("halo").over(w), F.lit(True)).cast("int").alias("starts"),
        *[F.lag("v", k).over(w).alias(f"b{k}") for k in range(1, REACH + 1)],
        *[F.lead("v", k).over(w).alias(f"f{k}") for k in range(1, REACH + 1)],
    )

    def steady(side: str) -> Column:
        """How many readings in a row next to this one keep at least a third of its value."""
        level_kept = [reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{side}{j}") * 3 >= F.col("v"), F.lit(False)) for j in range(1, k + 1)]) for k in range(1, REACH + 1)]
        return reduce(lambda a, b: a + b, [c.cast("int") for c in level_kept])

    x = x.select("household_id", "shard", "at_us", "kwh", "halo", "starts", "phi", "z", "z0", "z1", (steady("b") + steady("f") >= shift).alias("shifted"))

    def statistic(before: Column, after: Column) -> Column:
        """Additive-outlier statistic of a value against its neighbours under the AR(1)."""
        phi_ = F.col("phi")
        return ((F.col("z") - phi_ * before) - phi_ * (after - phi_ * F.col("z"))) / F.sqrt((1 + phi_ * phi_) * (1 - phi_ * phi_))

    x = x.withColumn("outlying", (statistic(F.col("z0"), F.col("z1")) > outlier) & ~F.col("shifted")).withColumn("late", F.col("outlying"))
    for _ in range(1, passes):
        x = x.withColumn("clean", F.when(F.col("outlying"), F.lit(0.0)).otherwise(F.col("z")))
        x = x.withColumns({"c0": F.coalesce(F.lag("clean").over(w), F.lit(0.0)), "c1": F.coalesce(F.lead("clean").over(w), F.lit(0.0))})
        x = x.withColumn("late", ~F.col("outlying") & (statistic(F.col("c0"), F.col("c1")) > outlier) & ~F.col("shifted")).withColumn("outlying", F.col("outlying") | F.col("late"))
    x = x.where(~F.col("halo"))
    return x.select("household_id", "shard", "at_us", "kwh", F.sum("starts").over(w).alias("run"), F.sum("starts").over(Window.partitionBy("household_id", "shard")).alias("runs"), "outlying", "late")


def _flagged(x: DataFrame, low: float, high: str, stuck_run: int) -> DataFrame:
    """The tested readings that can be reported or lie at a shard's ends, each with its shard's highest plain value."""
    shard = Window.partitionBy("household_id", "shard")
    bad = (F.col("kwh") < low) | (F.col("kwh") > F.lit(high).cast("decimal(28,10)"))
    at_edge = (F.col("run") == 1) | (F.col("run") == F.col("runs"))
    x = x.withColumn("run_n", F.count("*").over(Window.partitionBy("household_id", "shard", "run"))).withColumn("impossible", bad).withColumn("edge", at_edge)
    plain = ~F.col("impossible") & ~F.col("outlying") & ~F.col("edge") & ((F.col("run_n") < stuck_run) | (F.col("kwh") == 0))
    x = x.withColumn("top", F.max(F.when(plain, F.col("kwh"))).over(shard)).withColumn("first_row", (F.col("run") == 1))
    return materialize(
        x.where(F.col("impossible") | F.col("outlying") | F.col("edge") | ((F.col("run_n") >= stuck_run) & (F.col("kwh") != 0))),
        "implausible",
    )


def implausible(
    usable: DataFrame,
    low: float = 0,
    high: str = "11.5",
    stuck_run: int = 20,
    factor: int = 3,
    least: int = 20,
    outlier: float = 4.0,
    shift: int = REACH,
    shard_us: int = 28 * DAY_US,
) -> DataFrame:
    """(household_id, at_us, kwh, kind) of readings that are impossible, stuck or spikes.

    impossible: below ``low`` or above ``high``. stuck: part of ``stuck_run`` or more readings in a
    row, by time, with one value other than 0. spike: neither, and at least ``factor`` times the
    source's highest ordinary value. Sources with fewer than ``least`` readings give no rows; a
    reading both impossible and stuck gives one row of each kind. Ties at one instant are taken in
    order of value. An empty input gives no rows. The distinct readings, and later the flagged rows,
    are written once to the shared folder, since several steps read them. The outlier tests take
    ``FIRST_PASSES`` passes, and twice as many again in the shards where the last one flags a reading.
    """
    src = materialize(_sharded(usable, shard_us), "usable")
    base = _with_halo(src, shard_us)
    fits = materialize(_fitted(base, least), "fits")
    passes = FIRST_PASSES
    kept = _flagged(_tested(base, fits, outlier, shift, passes), low, high, stuck_run)
    while not kept.where("late").isEmpty():
        open_shards = kept.where("late").select("household_id", "shard").distinct()
        passes *= 2
        again = _flagged(_tested(_with_halo(src, shard_us, only=open_shards), fits, outlier, shift, passes), low, high, stuck_run)
        kept = kept.join(open_shards, ["household_id", "shard"], "left_anti").unionByName(again)
    runs = kept.where("edge").groupBy("household_id", "shard", "run").agg(F.first("kwh").alias("kwh"), F.first("run_n").alias("run_n"))
    scan = Window.partitionBy("household_id").orderBy("shard", "run")
    joined = runs.withColumn("new", (F.coalesce(F.lag("kwh").over(scan) != F.col("kwh"), F.lit(True)) | (F.col("run") > 1)).cast("int"))
    joined = joined.withColumn("island", F.sum("new").over(scan))
    joined = joined.select("household_id", "shard", "run", F.sum("run_n").over(Window.partitionBy("household_id", "island")).alias("joined_n"))
    marked = (
        kept.join(joined, ["household_id", "shard", "run"], "left")
        .withColumn("stuck", (F.coalesce("joined_n", "run_n") >= stuck_run) & (F.col("kwh") != 0))
        .withColumn("suspect", F.col("outlying") & ~F.col("impossible") & ~F.col("stuck"))
    )
    edge_plain = F.col("edge") & ~F.col("impossible") & ~F.col("stuck") & ~F.col("outlying")
    step = F.floor(F.ln(F.col("kwh").cast("double")) / 0.2)
    bins = marked.groupBy("household_id", F.when(F.col("suspect"), step).alias("bin")).agg(
        F.min(F.when(F.col("suspect"), F.col("kwh"))).alias("least"),
        F.max(F.when(F.col("suspect"), F.col("kwh"))).alias("most"),
        F.max(F.greatest("top", F.when(edge_plain, F.col("kwh")))).alias("top"),
    )
    rising = Window.partitionBy("household_id").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("ordinary", F.greatest(F.max("most").over(rising), F.max("top").over(Window.partitionBy("household_id"))))
    threshold = bins.where(F.col("least") >= F.col("ordinary") * factor).groupBy("household_id").agg(F.min("least").alias("from_kwh"))
    spikes = marked.where("suspect").join(threshold, "household_id").where(F.col("kwh") >= F.col("from_kwh"))
    cols = ["household_id", "at_us", "kwh"]
    return (
        marked.where(F.col("impossible") | F.col("stuck"))
        .select(*cols, F.explode(F.filter(F.array(F.when(F.col("impossible"), "impossible"), F.when(F.col("stuck"), "stuck")), lambda k: k.isNotNull())).alias("kind"))
        .unionByName(spikes.select(*cols, F.lit("spike").alias("kind")))
    )


def implausible_report(usable: DataFrame) -> DataFrame:
    """(household_id, observed_at, kind), one row for each flagged instant and kind."""
    return implausible(usable).select("household_id", stamp(from_micros(F.col("at_us"))).alias("observed_at"), "kind").distinct()
