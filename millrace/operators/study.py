"""The signal study: rank correlations, cutoffs, conditions and the quantile sweep.

Signals and targets are kept long, one row per symbol, week and name, so a whole grid
of cells is one join and one aggregation.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.rounding import published
from millrace.functions.windows import flag
from millrace.operators.calendar import resample_last
from millrace.operators.order import quantiles, with_average_ranks
from millrace.session import staged

SIGNALS = ("rsi14", "sector_corr_60", "trend_84d", "px_vs_ma200", "absorption_shift", "vol_own", "vol_rank_252", "vrp_proxy", "beta_60")
QUANTILES = tuple(k / 10 for k in range(1, 10))
LEAST_WEEKS, LEAST_SIDE, LEAST_DIFF = 30, 15, 10


def weekly(panel: DataFrame, since: str | None = None) -> DataFrame:
    """The last non-null value of each column by week ending on Friday."""
    rows = resample_last(panel, [c for c in panel.columns if c not in ("symbol", "date")], "week_friday")
    rows = rows.withColumnRenamed("label", "week")
    return rows if since is None else rows.where(F.col("week") >= F.lit(since).cast("date"))


def observed_weeks(weeks: DataFrame, columns: list[str]) -> DataFrame:
    seen = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    return weeks.groupBy("symbol").agg(F.count_if(seen).alias("n_weeks"))


def long(panel: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    return panel.unpivot(["symbol", "week"], columns, name, value)


def spearman(pairs: DataFrame, keys: list[str], least: int = LEAST_WEEKS) -> DataFrame:
    """(keys, n, ic) of pairs (s, t): correlation of average ranks, null for a constant side."""
    rows = staged(pairs.where("s is not null and t is not null").select(*keys, "s", "t"), "pairs")
    rows = with_average_ranks(with_average_ranks(rows, keys, "s", "rs"), keys, "t", "rt")
    sd = F.stddev_pop("rs") * F.stddev_pop("rt")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("rs", "rt").alias("_c"), sd.alias("_s"))
    return out.where(F.col("n") >= least).select(*keys, "n", F.try_divide("_c", F.nullif("_s", F.lit(0.0))).alias("ic"))


def breach_rates(weeks: DataFrame, breaches: list[str]) -> DataFrame:
    """(symbol, target, rate in %, median upside in %)."""
    rates = long(weeks, breaches, "target", "t").groupBy("symbol", "target").agg((F.avg("t") * 100.0).alias("rate"))
    tails = quantiles(weeks, ["symbol"], "upside_tail", (0.5,)).select("symbol", (F.get("quantiles", F.lit(0)) * 100.0).alias("median_tail"))
    return rates.join(tails, "symbol")


def cutoffs(weeks: DataFrame, columns: list[str], probabilities: tuple[float, ...]) -> DataFrame:
    """(symbol, signal, q, cut): exact linear quantiles of each signal; null for a signal without values."""
    found = quantiles(long(weeks, columns, "signal", "s"), ["symbol", "signal"], "s", probabilities)
    grid = F.posexplode("quantiles").alias("_k", "cut")
    qs = F.array(*map(F.lit, probabilities))
    return found.select("symbol", "signal", grid).select("symbol", "signal", F.element_at(qs, F.col("_k") + 1).alias("q"), "cut")


# The cutoffs taken from each symbol's weeks: name, signal, probability, digits.
CUTOFFS = (
    ("sector_corr_lo_tercile", "sector_corr_60", 1 / 3, 3), ("sector_corr_hi_tercile", "sector_corr_60", 2 / 3, 3), ("trend_84d_top_decile", "trend_84d", 0.9, 4),
    ("vol_lo_tercile", "vol_own", 1 / 3, 1), ("vol_hi_tercile", "vol_own", 2 / 3, 1), ("rsi14_lo_tercile", "rsi14", 1 / 3, 1),
)
# The published conditions: name, signal, comparison, and a number or the name of a cutoff.
CONDITIONS = (
    ("rsi14_lt_40", "rsi14", "<", 40.0), ("sector_corr_lt_0.45", "sector_corr_60", "<", 0.45), ("sector_corr_gt_0.70", "sector_corr_60", ">", 0.70),
    ("trend_84d_lt_0", "trend_84d", "<", 0.0), ("px_below_ma200", "px_vs_ma200", "<", 0.0), ("deep_dd_60_lt_-0.12", "deep_dd_60", "<=", -0.12),
    ("vol_top_tercile", "vol_own", ">=", "vol_hi_tercile"), ("sector_corr_lo_tercile", "sector_corr_60", "<", "sector_corr_lo_tercile"),
    ("sector_corr_hi_tercile", "sector_corr_60", ">", "sector_corr_hi_tercile"), ("trend_84d_top_decile", "trend_84d", ">", "trend_84d_top_decile"),
    ("vol_lo_tercile", "vol_own", "<", "vol_lo_tercile"), ("vol_hi_tercile", "vol_own", ">", "vol_hi_tercile"), ("rsi14_lo_tercile", "rsi14", "<", "rsi14_lo_tercile"),
)
COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def named_cutoffs(weeks: DataFrame, cutoffs: tuple = CUTOFFS) -> DataFrame:
    """(symbol, a column per cutoff), rounded as they are reported; ``cutoffs`` are rows like those of ``CUTOFFS``."""
    probabilities = tuple(sorted({q for _, _, q, _ in cutoffs}))
    found = quantiles(long(weeks, sorted({s for _, s, _, _ in cutoffs}), "signal", "s"), ["symbol", "signal"], "s", probabilities)
    at = lambda signal, q: F.max(F.when(F.col("signal") == signal, F.get("quantiles", F.lit(probabilities.index(q)))))
    return found.groupBy("symbol").agg(*[published(at(signal, q), digits).alias(name) for name, signal, q, digits in cutoffs])


def conditions(weeks: DataFrame, table: tuple = CONDITIONS, cutoffs: tuple = CUTOFFS) -> DataFrame:
    """(symbol, week, condition, on): named predicates, the thirteen published ones or a caller's; a null signal is off.

    Cutoffs are taken per symbol from all its weeks and rounded as they are reported:
    three digits for correlations, four for trends, one for the index and the oscillator.
    """
    rows = weeks.join(named_cutoffs(weeks, cutoffs), "symbol") if cutoffs else weeks
    against = lambda x: F.col(f"`{x}`") if isinstance(x, str) else F.lit(x)
    named = {name: COMPARE[how](F.col(signal), against(x)) for name, signal, how, x in table}
    flags = F.array(*[F.struct(F.lit(name).alias("condition"), flag(x).alias("on")) for name, x in named.items()])
    return rows.select("symbol", "week", F.inline(flags))


def bucket_difference(rows: DataFrame, keys: list[str], least: int = LEAST_DIFF) -> DataFrame:
    """(keys, n_on, n_off, diff): mean target where on less mean where off, null with too few of a side."""
    known = rows.where("t is not null")
    out = known.groupBy(*keys).agg(
        F.count_if("on").alias("n_on"), F.count_if(~F.col("on")).alias("n_off"), F.avg(F.when(F.col("on"), F.col("t"))).alias("_a"), F.avg(F.when(~F.col("on"), F.col("t"))).alias("_b")
    )
    enough = (F.col("n_on") >= least) & (F.col("n_off") >= least)
    return out.select(*keys, "n_on", "n_off", F.when(enough, F.col("_a") - F.col("_b")).alias("diff"))


def forest(weeks: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    on = conditions(weeks)
    t = long(targets, names, "target", "t")
    return bucket_difference(on.join(t, ["symbol", "week"]), ["symbol", "condition", "target"])


def sweep_cells(weeks: DataFrame, targets: DataFrame, signals: list[str], names: list[str], market: str | None = None) -> DataFrame:
    """Every (symbol, signal, q, target) cell's rows with ``on``: signal at or above its cutoff."""
    s = long(weeks, signals, "signal", "s")
    if market is not None:
        s = s.where(~((F.col("symbol") == market) & (F.col("signal") == "beta_60")))
    cuts = cutoffs(weeks, signals, QUANTILES)
    t = long(targets, names, "target", "t").where("t is not null")
    cells = s.join(cuts, ["symbol", "signal"])
    return cells.withColumn("on", flag(F.col("s") >= F.col("cut"))).join(t, ["symbol", "week"])


def sweep(weeks: DataFrame, targets: DataFrame, signals: list[str], names: list[str], market: str | None = None) -> DataFrame:
    """Per cell: side sizes, mean breach in % of each side (15 rows at least) and their difference (10)."""
    cells = sweep_cells(weeks, targets, signals, names, market)
    out = cells.groupBy("symbol", "signal", "q", "target").agg(
        F.count_if("on").alias("n_top"), F.count_if(~F.col("on")).alias("n_bottom"), F.avg(F.when(F.col("on"), F.col("t"))).alias("a"), F.avg(F.when(~F.col("on"), F.col("t"))).alias("b")
    )
    both = (F.col("n_top") >= LEAST_DIFF) & (F.col("n_bottom") >= LEAST_DIFF)
    return out.select(
        "symbol", "signal", "q", "target", "n_top", "n_bottom",
        F.when(F.col("n_top") >= LEAST_SIDE, F.col("a") * 100.0).alias("top"),
        F.when(F.col("n_bottom") >= LEAST_SIDE, F.col("b") * 100.0).alias("bottom"),
        F.when(both, (F.col("a") - F.col("b")) * 100.0).alias("diff"),
    )


def breach_grid(targets: DataFrame, names: list[str]) -> DataFrame:
    """Breach rates by symbol and multiple, with the totals over either and both."""
    t = long(targets, names, "target", "t")
    return t.cube("symbol", "target").agg(F.count("t").alias("n"), (F.avg("t") * 100.0).alias("rate"))


def significant(low: Column, high: Column) -> Column:
    return flag((low > 0) | (high < 0))
