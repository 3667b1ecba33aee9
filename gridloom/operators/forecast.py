"""Rolling-origin backtests of simple forecasts on daily series, without joins or loops.

A household's daily series becomes one row: an unbroken array of its days, at most as long as the
calendar, in which each day carries what a forecast made on it may know (its value, how many days of
its window are usable, the means over the last usable days of its weekday). Cases are unfolded from
that row, so the readings are scanned once and shuffled once after the daily aggregation.

No prediction sees a date after its origin: a case reads its target for scoring only, and else
days up to its origin. Days are daily records with ``unusable_reason``; all households are
evaluated at once. Households without any day, and empty tables, give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODELS = ("seasonal_naive", "last_day", "weekday_mean")
SCOREABLE, ABSENT = "scoreable", "absent"


@dataclass(frozen=True)
class Schedule:
    """Lengths in days; ``weeks`` is the number of same weekdays averaged."""

    horizon: int = 7
    warmup: int = 28
    holdout: int = 28
    step: int = 7
    min_run: int = 168
    weeks: int = 4
    window: int = 28
    min_usable: int = 20


def series(days: DataFrame, s: Schedule, weeks: tuple[int, ...] = ()) -> DataFrame:
    """(household_id, lo, hi, run, line): one row a household.

    ``line`` holds each date from lo to hi: its kWh if usable, its state, the usable days of the
    window that ends with it, and for each number of ``weeks`` the mean of the latest so many usable
    days of its weekday up to it with the oldest of them, null where there are too few. ``run`` is
    the longest run of usable days, the earliest of equals.
    """
    weeks = weeks or (s.weeks,)
    in_order = Window.partitionBy("household_id").orderBy("source_date")
    d = days.select("household_id", "source_date", F.col("kwh").cast("double").alias("kwh"), F.coalesce("unusable_reason", F.lit(SCOREABLE)).alias("state"))
    d = d.withColumn("next", F.lead("source_date").over(in_order))
    d = d.select("*", F.explode(F.sequence("source_date", F.coalesce(F.date_sub("next", 1), "source_date"))).alias("day"))
    own = F.col("day") == F.col("source_date")
    d = d.select("household_id", "day", F.when(own, F.col("state")).otherwise(ABSENT).alias("state"), F.when(own & (F.col("state") == SCOREABLE), F.col("kwh")).alias("kwh"))
    d = d.withColumns({"usable": F.col("state") == SCOREABLE, "dow": F.pmod(F.unix_date("day"), F.lit(7))})
    alike = Window.partitionBy("household_id", "dow", "usable").orderBy("day")
    means = {}
    for k in weeks:
        w = alike.rowsBetween(-(k - 1), 0)
        means[f"m{k}"] = F.when(F.col("usable") & (F.count("*").over(w) == k), F.struct(F.avg("kwh").over(w).alias("mean"), F.min("day").over(w).alias("oldest")))
    d = d.withColumns(means)
    carried = Window.partitionBy("household_id", "dow").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("household_id").orderBy(F.unix_date("day")).rangeBetween(-(s.window - 1), 0)
    place = F.row_number().over(Window.partitionBy("household_id", "usable").orderBy("day"))
    d = d.withColumns({f"m{k}": F.last(f"m{k}", ignorenulls=True).over(carried) for k in weeks} | {"in_window": F.count_if("usable").over(near), "island": F.date_sub("day", place)})
    island = Window.partitionBy("household_id", "usable", "island")
    d = d.withColumns({"start": F.min("day").over(island), "end": F.max("day").over(island), "days": F.count("*").over(island)})
    run = F.struct("start", "end", "days")
    return d.groupBy("household_id").agg(
        F.min("day").alias("lo"),
        F.max("day").alias("hi"),
        F.max_by(F.when(F.col("usable"), run), F.when(F.col("usable"), F.struct("days", -F.unix_date("start")))).alias("run"),
        F.array_sort(F.collect_list(F.struct("day", "kwh", "state", "in_window", *[f"m{k}" for k in weeks]))).alias("line"),
    )


def _steps(first: Column, last: Column, step: int) -> Column:
    """The dates from first to last every ``step`` days, none if first is later."""
    return F.when(first <= last, F.sequence(first, last, F.expr(f"INTERVAL {step} DAYS"))).otherwise(F.array().cast("array<date>"))


def _main_origins(s: Schedule) -> Column:
    """The origins of a household as (split, origin), none if its longest run is too short."""
    start, end = F.col("run.start"), F.col("run.end")
    holdout = F.date_sub(end, s.holdout - 1)
    named = lambda split, dates: F.transform(dates, lambda o: F.struct(F.lit(split).alias("split"), o.alias("origin")))
    dev = named("development", _steps(F.date_add(start, s.warmup - 1), F.date_sub(holdout, 1 + s.horizon), s.step))
    held = named("holdout", _steps(F.date_sub(holdout, 1), F.date_sub(end, s.horizon), s.step))
    return F.when(F.col("run.days") >= s.min_run, F.concat(dev, held))


def _on(day: Column) -> Column:
    """The day of the household's line at a date, null outside of it."""
    return F.get("line", F.datediff(day, F.col("lo")))


def _predictions(origin: Column, h: int, weeks: int, history_start: Column | None) -> dict[str, Column]:
    """Each model's prediction for ``h`` days after the origin."""
    target = F.date_add(origin, h)
    known = _on(F.date_sub(target, 7 * -(-h // 7)))  # the latest date of the target's weekday up to the origin
    mean = known[f"m{weeks}"]
    return {
        "seasonal_naive": known["kwh"] if h <= 7 else F.lit(None).cast("double"),
        "last_day": _on(origin)["kwh"],
        "weekday_mean": mean["mean"] if history_start is None else F.when(mean["oldest"] >= history_start, mean["mean"]),
    }


def origins(days: DataFrame, s: Schedule) -> DataFrame:
    """(household_id, run_start, run_end, split, origin) of households whose longest usable run is long enough."""
    return series(days, s).select("household_id", F.col("run.start").alias("run_start"), F.col("run.end").alias("run_end"), F.inline(_main_origins(s)))


def wide_cases(days: DataFrame, s: Schedule) -> DataFrame:
    """(household_id, split, origin, horizon, target_date, actual, one column a model, sees_holdout) of the main experiment.

    sees_holdout tells whether the origin, the latest day a model may use, lies in the holdout.
    """

    def case(o: Column, h: int) -> Column:
        made = _predictions(o["origin"], h, s.weeks, F.col("run.start"))
        target = F.date_add(o["origin"], h)
        return F.struct(o["split"].alias("split"), o["origin"].alias("origin"), F.lit(h).cast("bigint").alias("horizon"), target.alias("target_date"), _on(target)["kwh"].alias("actual"), *[c.alias(n) for n, c in made.items()], (o["origin"] >= F.date_sub(F.col("run.end"), s.holdout - 1)).alias("sees_holdout"))

    every = F.flatten(F.transform(_main_origins(s), lambda o: F.array(*[case(o, h) for h in range(1, s.horizon + 1)])))
    return series(days, s).select("household_id", F.inline(every))


def long_cases(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row a model: predicted, absolute error, and why there is none."""
    long = wide.unpivot([*keys, "actual"], list(MODELS), "model", "predicted")
    declined = F.when(F.col("actual").isNull(), "target_day_not_usable").when(
        F.col("predicted").isNull(),
        F.when(F.col("model") == "seasonal_naive", F.when(F.date_sub("target_date", 7) > F.col("origin"), "lag_day_after_origin").otherwise("lag_day_not_usable")).when(F.col("model") == "last_day", "origin_day_not_usable").otherwise("insufficient_same_weekday_history"),
    )
    return long.withColumn("excluded_reason", declined).withColumn("abs_error", F.when(declined.isNull(), F.abs(F.col("predicted") - F.col("actual"))))


KEYS = ["household_id", "split", "origin", "horizon", "target_date"]


def backtest(days: DataFrame, s: Schedule) -> DataFrame:
    """Every case of the main experiment, long by model."""
    return long_cases(wide_cases(days, s), KEYS)


def errors(cases: DataFrame, by: list[str]) -> DataFrame:
    """Scored cases, mean and exact median absolute error, the median of the middle pair."""
    scored = cases.where(F.col("abs_error").isNotNull())
    return scored.groupBy(*by).agg(F.count("*").alias("scored"), F.round(F.avg("abs_error"), 6).alias("mae"), F.round(F.median("abs_error"), 6).alias("median_ae"))


def common_frame(wide: DataFrame) -> DataFrame:
    """Cases every model scored, long by model: a case's models stand in one row, so this is a filter."""
    scored = [F.col(c).isNotNull() for c in ("actual", *MODELS)]
    return long_cases(wide.where(scored[0] & scored[1] & scored[2] & scored[3]), KEYS)


def weeks_sweep(days: DataFrame, s: Schedule, candidates: tuple[int, ...]) -> DataFrame:
    """(weeks, scored, mae): the weekday mean for each number of weeks on the development cases all of them score."""

    def case(o: Column, h: int) -> Column:
        made = [_predictions(o["origin"], h, k, F.col("run.start"))["weekday_mean"].alias(f"p{k}") for k in candidates]
        return F.struct(_on(F.date_add(o["origin"], h))["kwh"].alias("actual"), *made)

    dev = F.filter(_main_origins(s), lambda o: o["split"] == "development")
    cases = series(days, s, candidates).select(F.inline(F.flatten(F.transform(dev, lambda o: F.array(*[case(o, h) for h in range(1, s.horizon + 1)])))))
    cases = cases.dropna()
    one = cases.select(F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("weeks"), F.abs(F.col(f"p{k}") - F.col("actual")).alias("e")) for k in candidates])))
    return one.groupBy("weeks").agg(F.count("*").alias("scored"), F.round(F.avg("e"), 6).alias("mae"))


def best_weeks(sweep: DataFrame) -> DataFrame:
    """(weeks, mae): the candidate with the smallest error, the smaller of equals."""
    return sweep.agg(F.min_by(F.struct("weeks", "mae"), F.struct("mae", "weeks")).alias("b")).where("b is not null").select("b.*")


def origin_calendar(days: DataFrame, s: Schedule) -> DataFrame:
    """The shared calendar of origins from the global first date + window - 1, while targets exist."""
    b = days.agg(F.min("source_date").alias("lo"), F.max("source_date").alias("hi"))
    return b.select(F.explode(_steps(F.date_add("lo", s.window - 1), F.date_sub("hi", s.horizon), s.step)).alias("origin"))


def _prior(days: DataFrame, s: Schedule, *more: Column) -> DataFrame:
    """``more`` and one row a household x origin x horizon of the shared calendar; ``days`` is read twice."""
    calendar = days.agg(F.struct(F.min("source_date").alias("lo"), F.max("source_date").alias("hi"))).scalar()
    shared = series(days, s).withColumn("calendar", calendar)
    dates = _steps(F.date_add("calendar.lo", s.window - 1), F.date_sub("calendar.hi", s.horizon), s.step)

    def case(o: Column, h: int) -> Column:
        at, target = _on(o), F.date_add(o, h)
        state = F.when(at["kwh"].isNull(), "origin_day_not_usable").when(at["in_window"] < s.min_usable, "thin_window").otherwise("issued")
        issued = state == "issued"
        return F.struct(
            o.alias("origin"),
            F.lit(h).cast("bigint").alias("horizon"),
            target.alias("target_date"),
            F.coalesce(_on(target)["state"], F.lit(ABSENT)).alias("target_state"),
            state.alias("prediction_state"),
            F.when(issued, _on(target)["kwh"]).alias("actual"),
            *[F.when(issued, c).alias(n) for n, c in _predictions(o, h, s.weeks, None).items()],
        )

    return shared.select("household_id", *more, F.inline(F.flatten(F.transform(dates, lambda o: F.array(*[case(o, h) for h in range(1, s.horizon + 1)])))))


def prior_cases(days: DataFrame, s: Schedule) -> DataFrame:
    """Every household x origin x horizon of the shared calendar, with both states and the predictions of issued ones.

    A household qualifies at an origin it can use if at least ``min_usable`` of the ``window``
    dates up to it are usable; the target's state is judged apart from that.
    """
    return _prior(days, s).drop("actual")


def prior_coverage(days: DataFrame, s: Schedule) -> DataFrame:
    """Cases by the two independent states."""
    return _prior(days, s).groupBy("prediction_state", "target_state").agg(F.count("*").alias("cases"))


def prior_report(days: DataFrame, s: Schedule) -> DataFrame:
    """Per model: scheduled, issued, scoreable and scored cases, and mean absolute error of the scored."""
    long = _prior(days, s).unpivot(["prediction_state", "target_state", "actual"], list(MODELS), "model", "predicted")
    issued, scoreable = F.col("prediction_state") == "issued", F.col("target_state") == SCOREABLE
    error = F.when(issued & scoreable, F.abs(F.col("predicted") - F.col("actual")))
    return long.groupBy("model").agg(
        F.count("*").alias("scheduled"),
        F.count_if(issued).alias("issued"),
        F.count_if(issued & F.col("predicted").isNull()).alias("declined"),
        F.count_if(issued & scoreable).alias("scoreable"),
        F.count(error).alias("scored"),
        F.round(F.avg(error), 6).alias("mae"),
    )


def observed_vs_predicted(wide: DataFrame) -> DataFrame:
    """Wide by model: one row a household, origin and target."""
    return wide.select("household_id", "origin", "target_date", "actual", *MODELS)


def worst_cases(cases: DataFrame, limit: int = 10) -> DataFrame:
    """The cases with the largest errors, in a total order; the limit is the feature."""
    return cases.where(F.col("abs_error").isNotNull()).orderBy(F.desc(F.round("abs_error", 6)), "household_id", "origin", "horizon", "model").limit(limit)


def exclusions(cases: DataFrame) -> DataFrame:
    """Cases by split, model and reason, scored ones as ``scored``."""
    return cases.groupBy("split", "model", F.coalesce("excluded_reason", F.lit("scored")).alias("reason")).agg(F.count("*").alias("cases"))


def split_counts(wide: DataFrame) -> DataFrame:
    """Per split: households, origins, distinct targets and target dates, repeated targets, and cases
    whose inputs reach into the holdout.

    Counted in two levels: per household first, where nothing repeats across households.
    """
    per = wide.groupBy("split", "household_id").agg(F.collect_set("origin").alias("o"), F.collect_set("target_date").alias("t"), F.count("*").alias("n"), F.count_if("sees_holdout").alias("seen"))
    dates = per.select("split", F.explode("t").alias("date")).distinct().groupBy("split").agg(F.count("*").alias("target_dates"))
    counts = per.groupBy("split").agg(F.count("*").alias("households"), F.sum(F.size("o")).alias("origins"), F.sum(F.size("t")).alias("targets"), F.sum(F.col("n") - F.size("t")).alias("repeated_targets"), F.sum("seen").alias("holdout_inputs"))
    return counts.join(dates, "split")


def overlap(days: DataFrame, s: Schedule) -> DataFrame:
    """(kind, cases): issued cases of the prior-data experiment that the main one has too, and the rest."""
    prior = _prior(days, s, F.transform(_main_origins(s), lambda o: o["origin"]).alias("mine")).where("prediction_state = 'issued'")
    shared = F.coalesce(F.array_contains("mine", F.col("origin")), F.lit(False))
    return prior.groupBy(F.when(shared, "shared").otherwise("new").alias("kind")).agg(F.count("*").alias("cases"))


def cohort_composition(readings: DataFrame, days: DataFrame, s: Schedule) -> DataFrame:
    """Households of the experiment by their tariff groups and the number of members they came from."""
    chosen = series(days, s).where(F.size(F.coalesce(_main_origins(s), F.array())) > 0).select("household_id")
    facts = readings.select("household_id", "tariff_group", "member_name").distinct()
    per = facts.join(chosen, "household_id", "left_semi").groupBy("household_id").agg(F.array_join(F.array_sort(F.collect_set("tariff_group")), " | ").alias("groups"), F.count_distinct("member_name").alias("members"))
    return per.groupBy("groups", "members").agg(F.count("*").alias("households"))


def first_eligible(days: DataFrame, s: Schedule, limit: int = 40) -> DataFrame:
    """The first ``limit`` households by id whose longest run is long enough; the limit is the feature."""
    fits = series(days, s).where(F.col("run.days") >= s.min_run)
    return fits.select("household_id", F.col("run.days").alias("days")).orderBy("household_id").limit(limit)
