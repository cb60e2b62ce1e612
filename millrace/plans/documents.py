"""The study's two documents: research by target, fund and signal, and the quantile sweep by fund, signal, multiple and quantile.

Cells are computed long, a row each; here they are rounded to the digits they are
published with and nested into maps, so that one JSON document holds them by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.rounding import published as rounded
from millrace.operators import bootstrap, study, targets

FORWARD = ("fwd_ret", "upside_tail", "vol_norm_ret")
#: What the forest calls its targets.
FOREST = {targets.breach(1.2): "breach", "upside_tail": "upside_tail", "fwd_ret": "fwd_ret"}


def study_parts(signals: DataFrame, goals: DataFrame, market: str) -> dict[str, DataFrame]:
    """Every table of the study, unrounded: a row per cell."""
    columns, breaches = list(study.SIGNALS), [targets.breach(m) for m in targets.MULTIPLES]
    swept = [*columns, "deep_dd_60"]
    pairs = study.long(signals, columns, "signal", "s").join(study.long(goals, [*FORWARD, targets.breach(1.2)], "target", "t"), ["symbol", "week"])
    forest = study.conditions(signals).join(study.long(goals, list(FOREST), "target", "t"), ["symbol", "week"])
    cells = study.sweep_cells(signals, goals, swept, breaches, market)
    cell = ["symbol", "signal", "target", "q"]
    return {
        "ic": bootstrap.ic_interval(pairs, ["target", "symbol", "signal"]),
        "breach_rates": study.breach_rates(goals, breaches),
        "cutoffs": study.named_cutoffs(signals),
        "forest": bootstrap.difference_interval(forest, ["target", "symbol", "condition"], draws=1500),
        "weeks": study.observed_weeks(signals, swept),
        "unconditional": bootstrap.mean_interval(study.long(goals, breaches, "target", "t"), ["symbol", "target"]),
        "sides": bootstrap.mean_interval(cells, [*cell, "on"]),
        "sweep": bootstrap.difference_interval(cells, cell),
        "quantiles": study.cutoffs(signals, swept, study.QUANTILES),
    }


def nested(rows: DataFrame, levels: list[str], value: Column) -> DataFrame:
    """One row with the column ``v``: maps by ``levels``, outermost first, of ``value``; keys in order."""
    cur = rows.select(*[F.col(c).cast("string").alias(c) for c in levels], value.alias("v"))
    before = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    for i in reversed(range(len(levels))):
        entries = F.array_sort(F.collect_list(F.struct(F.col(levels[i]).alias("k"), "v")), before)
        cur = cur.groupBy(*levels[:i]).agg(F.map_from_entries(entries).alias("v"))
    return cur


def percent(c: str, digits: int) -> Column:
    return rounded(F.col(c) * 100.0, digits)


def multiple(target: str = "target") -> Column:
    """The multiple in a breach's name, as the documents write it."""
    names = {targets.breach(m): str(float(m)) for m in targets.MULTIPLES}
    return reduce(lambda out, k: out.when(F.col(target) == k, names[k]), names, F.when(F.lit(False), ""))


# Names that the documents write otherwise than the tables.
PUBLISHED = {"beta_60": "beta_spy_60", targets.breach(1.2): "breach_1.2"}


def published(c: str) -> Column:
    return reduce(lambda out, k: F.when(F.col(c) == k, PUBLISHED[k]).otherwise(out), PUBLISHED, F.col(c)).alias(c)


def _document(**parts: DataFrame | Column) -> DataFrame:
    """One row with a column per part."""
    frames = [f.select(F.col("v").alias(k)) for k, f in parts.items() if isinstance(f, DataFrame)]
    out = reduce(lambda a, b: a.join(b), frames)  # one row each
    return out.select(*[(F.col(k) if isinstance(f, DataFrame) else f).alias(k) for k, f in parts.items()])


def research(parts: dict[str, DataFrame], start: str, horizon: int = targets.HORIZON) -> DataFrame:
    c = F.col
    sig = study.significant(c("low"), c("high"))
    ic = F.struct(rounded(c("ic"), 3).alias("ic"), rounded(c("low"), 3).alias("lo"), rounded(c("high"), 3).alias("hi"), "n", sig.alias("sig"))
    rates = parts["breach_rates"].select("symbol", multiple().alias("key"), rounded(c("rate"), 1).alias("x"))
    tails = parts["breach_rates"].select("symbol", F.lit("median_upside_tail").alias("key"), rounded(c("median_tail"), 2).alias("x")).distinct()
    cuts = parts["cutoffs"].unpivot(["symbol"], [name for name, *_ in study.CUTOFFS], "key", "x")
    side = F.struct(percent("diff", 3).alias("point"), percent("low", 3).alias("lo"), percent("high", 3).alias("hi"), c("n_on").alias("n"))
    name = reduce(lambda out, k: out.when(c("target") == k, FOREST[k]), FOREST, F.when(F.lit(False), ""))
    return _document(
        start=F.lit(start),
        horizon_days=F.lit(horizon),
        breach_rates=nested(rates.union(tails), ["symbol", "key"], c("x")),
        vol_tercile=nested(parts["cutoffs"], ["symbol"], c("vol_hi_tercile")),
        cutoffs=nested(cuts, ["symbol", "key"], c("x")),
        ic_table=nested(parts["ic"].withColumns({k: published(k) for k in ("target", "signal")}), ["target", "symbol", "signal"], ic),
        forest=nested(parts["forest"].withColumn("target", name), ["symbol", "condition", "target"], F.when(c("diff").isNotNull(), side)),
        n_weekly_obs=nested(parts["weeks"], ["symbol"], c("n_weeks")),
    )


def threshold_sweep(parts: dict[str, DataFrame]) -> DataFrame:
    c = F.col
    mean = F.when(c("mean").isNotNull(), F.struct(percent("mean", 2).alias("point"), percent("low", 2).alias("lo"), percent("high", 2).alias("hi"), "n"))
    diff = F.struct(percent("diff", 2).alias("point"), percent("low", 2).alias("lo"), percent("high", 2).alias("hi"), c("n_on").alias("n_top"), c("n_off").alias("n_bottom"))
    cell = ["symbol", "signal", "target", "q"]
    sides = parts["sides"]
    side = lambda on, k: sides.where(c("on") if on else ~c("on")).select(*cell, mean.alias(k))
    cells = parts["sweep"].select(*cell, F.when(c("diff").isNotNull(), diff).alias("diff"))
    for k, on in (("top", True), ("bottom", False)):
        cells = cells.join(side(on, k), cell, "left")
    cells = cells.join(parts["quantiles"], ["symbol", "signal", "q"])
    entry = F.struct(
        rounded(c("cut"), 4).alias("cutoff"), F.round((F.lit(1.0) - c("q")) * 100.0, 0).alias("top_pct"), F.round(c("q") * 100.0, 0).alias("bottom_pct"), "top", "bottom", "diff"
    )
    named = cells.withColumn("signal", published("signal")).withColumn("mult", multiple()).withColumn("pct", F.round(c("q") * 100.0, 0).cast("int"))
    return _document(
        unconditional=nested(parts["unconditional"].withColumn("mult", multiple()), ["symbol", "mult"], mean),
        sweep=nested(named, ["symbol", "signal", "mult", "pct"], entry),
    )
