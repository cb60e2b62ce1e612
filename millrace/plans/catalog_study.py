"""Registered queries of the signal study and of the bootstrap."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rounding import published_sql
from millrace.operators import bootstrap, study, targets
from millrace.plans.catalog import BREACHES, LAGGED, MARKET, PANEL_TABLES, TARGETS, labels, panel, query, r, rounded, weekly_sql
from millrace.plans import documents
from millrace.plans import oracle_draws as draws_sql
from millrace.plans.oracle_base import with_tables
from millrace.session import staged

SIG = list(study.SIGNALS)
TGT = ["fwd_ret", "upside_tail", "vol_norm_ret", *BREACHES]
ALL = [*SIG, "deep_dd_60"]


def weeks(spark: SparkSession, d: str, since: str | None = None) -> DataFrame:
    """Each week's signals, computed once for all that reads them."""
    return staged(study.weekly(panel(spark, d), since), "weeks")


def goals(spark: SparkSession, d: str, since: str | None = None) -> DataFrame:
    """Each week's targets, computed once for all that reads them."""
    return staged(study.weekly(labels(spark, d).select("symbol", "date", *TGT), since), "goals")


TW = TARGETS | weekly_sql("targets", TGT)
SW = LAGGED | weekly_sql("panel", ALL)
BOTH = LAGGED | {k: v for k, v in TARGETS.items() if k not in LAGGED} | weekly_sql("panel", ALL) | weekly_sql("targets", TGT)


def unpivot(table: str, columns: list[str], name: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT symbol, week, '{c}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {table}" for c in columns)


@query("breach_rates", with_tables("px", "vol", extra=TW | {"l": unpivot("targets_w", BREACHES, "target", "t"), "m": "SELECT symbol, median(upside_tail) * 1e2 AS median_tail FROM targets_w GROUP BY 1"})
       + f"SELECT l.symbol, l.target, {r('avg(t) * 1e2', 'rate')}, {r('max(m.median_tail)', 'median_tail')} FROM l JOIN m ON l.symbol = m.symbol GROUP BY 1, 2")
def breach_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.breach_rates(goals(spark, d), BREACHES))


@query("rollup_breach_grid", with_tables("px", "vol", extra=TW | {"l": unpivot("targets_w", BREACHES, "target", "t")})
       + f"SELECT symbol, target, count(t) AS n, {r('avg(t) * 1e2', 'rate')} FROM l GROUP BY CUBE (symbol, target)")
def rollup_breach_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.breach_grid(goals(spark, d), BREACHES))


@query("observed_weeks", with_tables(*PANEL_TABLES, extra=SW) + f"SELECT symbol, count(*) FILTER (WHERE {' OR '.join(f'{c} IS NOT NULL' for c in ALL)}) AS n_weeks FROM panel_w GROUP BY 1")
def observed_weeks(spark: SparkSession, d: str) -> DataFrame:
    return study.observed_weeks(weeks(spark, d), ALL)


QS = [k / 10 for k in range(1, 10)]
CUTS = {
    "sl": unpivot("panel_w", SIG, "signal", "s"),
    "cuts": "SELECT symbol, signal, q, cut FROM (SELECT symbol, signal, unnest([" + ", ".join(f"{q}e0" for q in QS) + "]) AS q, unnest(quantile_cont(s, [" + ", ".join(map(str, QS)) + "])) AS cut FROM sl GROUP BY symbol, signal)",
}


@query("quantile_cutoffs", with_tables(*PANEL_TABLES, extra=SW | CUTS) + f"SELECT symbol, signal, q, {r('cut', 'cut')} FROM cuts")
def quantile_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.cutoffs(weeks(spark, d), SIG, study.QUANTILES))


COND = {
    "cq": "SELECT symbol, " + ", ".join(f'quantile_cont({signal}, CAST({q!r} AS DOUBLE)) AS "raw_{name}"' for name, signal, q, _ in study.CUTOFFS) + " FROM panel_w GROUP BY 1",
    "cc": "SELECT symbol, " + ", ".join(published_sql(f'"raw_{name}"', digits) + f' AS "cut_{name}"' for name, _, _, digits in study.CUTOFFS) + " FROM cq",
    "cw": "SELECT w.*, cc.* EXCLUDE (symbol) FROM panel_w w JOIN cc ON w.symbol = cc.symbol",
    "on1": " UNION ALL ".join(
        f"SELECT symbol, week, '{name}' AS condition, coalesce({signal} {how} " + (f'"cut_{x}"' if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)") + ", false) AS is_on FROM cw"
        for name, signal, how, x in study.CONDITIONS
    ),
}
FT = ["fwd_ret", "upside_tail", "vol_norm_ret"]


@query("threshold_forest_points", with_tables(*PANEL_TABLES, extra=BOTH | COND | {"l": unpivot("targets_w", FT, "target", "t")}) + f"""
SELECT symbol, condition, target, count(*) FILTER (WHERE is_on) AS n_on, count(*) FILTER (WHERE NOT is_on) AS n_off,
{r('CASE WHEN count(*) FILTER (WHERE is_on) >= 10 AND count(*) FILTER (WHERE NOT is_on) >= 10 THEN avg(t) FILTER (WHERE is_on) - avg(t) FILTER (WHERE NOT is_on) END', 'diff')}
FROM on1 JOIN l USING (symbol, week) WHERE t IS NOT NULL GROUP BY 1, 2, 3""")
def threshold_forest_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.forest(weeks(spark, d), goals(spark, d), FT))


SWEEP = CUTS | {"l": unpivot("targets_w", BREACHES, "target", "t")}


@query("quantile_sweep_points", with_tables(*PANEL_TABLES, extra=BOTH | SWEEP | {"cells": f"""
SELECT sl.symbol, sl.signal, q, target, t, coalesce(s >= cut, false) AS is_on FROM sl JOIN cuts ON sl.symbol = cuts.symbol AND sl.signal = cuts.signal
JOIN l ON l.symbol = sl.symbol AND l.week = sl.week WHERE t IS NOT NULL AND NOT (sl.symbol = '{MARKET}' AND sl.signal = 'beta_60')""", "agg": """
SELECT symbol, signal, q, target, count(*) FILTER (WHERE is_on) AS n_top, count(*) FILTER (WHERE NOT is_on) AS n_bottom, avg(t) FILTER (WHERE is_on) AS a, avg(t) FILTER (WHERE NOT is_on) AS b
FROM cells GROUP BY 1, 2, 3, 4"""}) + f"""SELECT symbol, signal, q, target, n_top, n_bottom, {r('CASE WHEN n_top >= 15 THEN a * 1e2 END', 'top')}, {r('CASE WHEN n_bottom >= 15 THEN b * 1e2 END', 'bottom')},
{r('CASE WHEN n_top >= 10 AND n_bottom >= 10 THEN (a - b) * 1e2 END', 'diff')} FROM agg""")
def quantile_sweep_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.sweep(weeks(spark, d), goals(spark, d), SIG, BREACHES, MARKET))


IC = ["fwd_ret", "upside_tail", "vol_norm_ret", BREACHES[0]]


def ic_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = study.long(weeks(spark, d), SIG, "signal", "s")
    t = study.long(goals(spark, d), IC, "target", "t")
    return s.join(t, ["symbol", "week"])


RANK = "rank() OVER (PARTITION BY symbol, signal, target ORDER BY {0}) + (count(*) OVER (PARTITION BY symbol, signal, target, {0}) - 1) / 2e0"


@query("spearman_ic", with_tables(*PANEL_TABLES, extra=BOTH | {
    "sl": unpivot("panel_w", SIG, "signal", "s"), "l": unpivot("targets_w", IC, "target", "t"),
    "ranked": f"SELECT symbol, signal, target, {RANK.format('s')} AS rs, {RANK.format('t')} AS rt FROM (SELECT sl.symbol, sl.signal, l.target, s, t FROM sl JOIN l ON l.symbol = sl.symbol AND l.week = sl.week WHERE s IS NOT NULL AND t IS NOT NULL)"})
    + f"SELECT symbol, signal, target, count(*) AS n, {r('covar_pop(rs, rt) / nullif(stddev_pop(rs) * stddev_pop(rt), 0e0)', 'ic')} FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 30")
def spearman_ic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.spearman(ic_pairs(spark, d), ["symbol", "signal", "target"]))


@query("block_bootstrap_ic")
def block_bootstrap_ic(spark: SparkSession, d: str) -> DataFrame:
    out = bootstrap.ic_interval(ic_pairs(spark, d), ["symbol", "signal", "target"])
    return rounded(out.withColumn("significant", study.significant(F.col("low"), F.col("high"))))


def breach_cells(spark: SparkSession, d: str) -> DataFrame:
    """Weekly breaches, on where the volatility index is at or above 18."""
    w = weeks(spark, d).select("symbol", "week", F.coalesce(F.col("vol_own") >= 18.0, F.lit(False)).alias("on"))
    return w.join(goals(spark, d).select("symbol", "week", F.col(BREACHES[0]).alias("t")), ["symbol", "week"]).where("t is not null")


DRAWN = {
    "bc": f"SELECT p.symbol, p.week, coalesce(p.vol_own >= 1.8e1, false) AS is_on, g.{BREACHES[0]} AS t FROM panel_w p JOIN targets_w g ON g.symbol = p.symbol AND g.week = p.week WHERE g.{BREACHES[0]} IS NOT NULL",
    "num": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bc",
    "places": "SELECT symbol, n, draw, unnest(range(n)) AS k FROM (SELECT symbol, count(*) AS n, unnest(range(1000)) AS draw FROM bc GROUP BY symbol)",
    "drawn": """SELECT p.symbol, draw, num.is_on, num.t FROM places p JOIN num ON num.symbol = p.symbol
      AND num.pos = (draw * 7919 + (k // 8) * 104729 + 11) % greatest(1, p.n - 8 + 1) + k % 8""",
}


@query("block_bootstrap_mean", with_tables(*PANEL_TABLES, extra=BOTH | DRAWN | {"ms": "SELECT symbol, draw, avg(t) AS m FROM drawn GROUP BY 1, 2"})
       + f"SELECT symbol, count(*) AS draws, {r('quantile_cont(m, 5e-2)', 'low')}, {r('quantile_cont(m, 9.5e-1)', 'high')} FROM ms GROUP BY 1")
def block_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    drawn = bootstrap.relational(breach_cells(spark, d), ["symbol"])
    means = drawn.groupBy("symbol", "draw").agg(F.avg("t").alias("m"))
    return rounded(means.groupBy("symbol").agg(F.count("*").alias("draws"), F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high")))


@query("block_bootstrap_diff", with_tables(*PANEL_TABLES, extra=BOTH | DRAWN | {"ds": """
SELECT symbol, draw, avg(t) FILTER (WHERE is_on) - avg(t) FILTER (WHERE NOT is_on) AS m FROM drawn GROUP BY 1, 2
HAVING count(*) FILTER (WHERE is_on) >= 3 AND count(*) FILTER (WHERE NOT is_on) >= 3"""})
       + f"SELECT symbol, count(*) AS draws, {r('quantile_cont(m, 5e-2)', 'low')}, {r('quantile_cont(m, 9.5e-1)', 'high')} FROM ds GROUP BY 1")
def block_bootstrap_diff(spark: SparkSession, d: str) -> DataFrame:
    drawn = bootstrap.relational(breach_cells(spark, d), ["symbol"])
    sides = drawn.groupBy("symbol", "draw").agg(
        F.count_if("on").alias("a"), F.count_if(~F.col("on")).alias("b"), (F.avg(F.when(F.col("on"), F.col("t"))) - F.avg(F.when(~F.col("on"), F.col("t")))).alias("m")
    )
    sides = sides.where("a >= 3 and b >= 3")
    return rounded(sides.groupBy("symbol").agg(F.count("*").alias("draws"), F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high")))


def drawn_sql(cells: str, keys: str, least: int, block: int, draws: int, seed: int = 11) -> dict[str, str]:
    """Extra tables from ``cells`` (keys, week, t, is_on): running sums of each cell as lists, and the seeded blocks of a draw as a list."""
    runs = {"t": "t", "a": "CASE WHEN is_on THEN t ELSE 0 END", "k": "CASE WHEN is_on THEN 1 ELSE 0 END"}
    summed = ", ".join(f"sum(CAST({x} AS DOUBLE)) OVER (PARTITION BY {keys} ORDER BY week) AS {c}" for c, x in runs.items())
    return {
        "summed": f"SELECT {keys}, week, {summed} FROM {cells}",
        "runs": f"SELECT {keys}, count(*) AS n, CAST(max(k) AS BIGINT) AS n_on, {', '.join(f'[0e0] || list({c} ORDER BY week) AS {c}' for c in runs)} FROM summed GROUP BY {keys}",
    } | draws_sql.starts(f"SELECT n FROM runs WHERE n >= {least}", seed, block, draws) | {
        "blocks": "SELECT n, draw, list(s) AS s, list(s + len) AS e FROM starts GROUP BY n, draw",
        "draws": f"SELECT {keys}, n, n_on, draw, " + ", ".join(f"list_sum(list_transform(e, lambda i: {c}[i + 1])) - list_sum(list_transform(s, lambda i: {c}[i + 1])) AS {c}" for c in runs) + " FROM runs JOIN blocks USING (n)",
    }


def between(x: str, low: float, high: float) -> str:
    return f"{r(f'quantile_cont({x}, {low!r})', 'low')}, {r(f'quantile_cont({x}, {high!r})', 'high')}"


@query("block_bootstrap_exact_mean", with_tables(*PANEL_TABLES, extra=BOTH | {"bc": DRAWN["bc"]} | drawn_sql("bc", "symbol, is_on", 15, 8, 1000)) + f"""
SELECT runs.symbol, runs.is_on AS "on", n, mean, low, high FROM (SELECT symbol, is_on, n, CASE WHEN n >= 15 THEN {r('t[n + 1] / n', 'x').removesuffix(' AS x')} END AS mean FROM runs) runs
LEFT JOIN (SELECT symbol, is_on, {between('t / n', 0.05, 0.95)} FROM draws GROUP BY 1, 2) i ON runs.symbol = i.symbol AND runs.is_on = i.is_on""")
def block_bootstrap_exact_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.mean_interval(breach_cells(spark, d), ["symbol", "on"]))


def difference_sql(keys: str) -> str:
    """Rows of ``difference_interval`` from the tables of ``drawn_sql``."""
    apart = "CASE WHEN k >= 3 AND n - k >= 3 THEN a / k - (t - a) / (n - k) END"
    point = "CASE WHEN n_on >= 10 AND n - n_on >= 10 THEN a[n + 1] / n_on - (t[n + 1] - a[n + 1]) / (n - n_on) END"
    return f"""SELECT {keys}, n_on, n - n_on AS n_off, {r(point, 'diff')}, low, high FROM runs
LEFT JOIN (SELECT {keys}, {between(apart, 0.05, 0.95)} FROM draws WHERE n_on >= 10 AND n - n_on >= 10 GROUP BY {keys}) USING ({keys})"""


@query("block_bootstrap_exact_diff", with_tables(*PANEL_TABLES, extra=BOTH | {"bc": DRAWN["bc"]} | drawn_sql("bc", "symbol", 20, 8, 1000)) + difference_sql("symbol"))
def block_bootstrap_exact_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.difference_interval(breach_cells(spark, d), ["symbol"]))


@query("block_bootstrap_median", with_tables("px", "vol", extra=TW | {
    "u": "SELECT symbol, week, upside_tail AS t, row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM targets_w WHERE upside_tail IS NOT NULL"}
    | draws_sql.starts("SELECT n FROM u WHERE n >= 5", 7, 10, 2000) | {
    "drawn": "SELECT u.symbol, draw, median(t) AS m FROM (SELECT n, draw, unnest(range(s, s + len)) AS pos FROM starts) d JOIN u USING (n, pos) GROUP BY 1, 2"})
       + f"SELECT symbol, u.n, low, high FROM (SELECT symbol, count(*) AS n FROM u GROUP BY 1) u LEFT JOIN (SELECT symbol, {between('m', 0.025, 0.975)} FROM drawn GROUP BY 1) USING (symbol)")
def block_bootstrap_median(spark: SparkSession, d: str) -> DataFrame:
    """The interval of any statistic, here the median upside tail of each symbol's weeks."""
    tails = goals(spark, d).select("symbol", "week", F.col("upside_tail").alias("t"))
    return rounded(bootstrap.statistic_intervals(tails, ["symbol"], np.median))


@query("quantile_sweep_intervals", with_tables(*PANEL_TABLES, extra=BOTH | SWEEP | {"cells": f"""
SELECT sl.symbol, sl.signal, q, target, l.week, t, coalesce(s >= cut, false) AS is_on FROM sl JOIN cuts ON sl.symbol = cuts.symbol AND sl.signal = cuts.signal
JOIN l ON l.symbol = sl.symbol AND l.week = sl.week WHERE t IS NOT NULL AND NOT (sl.symbol = '{MARKET}' AND sl.signal = 'beta_60')"""}
    | drawn_sql("cells", "symbol, signal, q, target", 20, 8, 1000)) + difference_sql("symbol, signal, q, target"))
def quantile_sweep_intervals(spark: SparkSession, d: str) -> DataFrame:
    cells = study.sweep_cells(weeks(spark, d), goals(spark, d), SIG, BREACHES, MARKET)
    return rounded(bootstrap.difference_interval(cells, ["symbol", "signal", "q", "target"]))


#: The first week of the documents.
SINCE = "1995-01-01"


def study_parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return documents.study_parts(weeks(spark, d, SINCE), goals(spark, d, SINCE), MARKET)


def since(tables: dict[str, str]) -> dict[str, str]:
    """Extra tables over the documents' weeks only."""
    late = lambda sql: sql.replace("panel_w", "panel_s").replace("targets_w", "targets_s")
    return {f"{k}_s": f"SELECT * FROM {k}_w WHERE week >= DATE '{SINCE}'" for k in ("panel", "targets")} | {k: late(v) for k, v in tables.items()}


@query("research_document")
def research_document(spark: SparkSession, d: str) -> DataFrame:
    """The research document, a row with its text."""
    return documents.research(study_parts(spark, d), SINCE).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


@query("sweep_document")
def sweep_document(spark: SparkSession, d: str) -> DataFrame:
    """The sweep document, a row with its text."""
    return documents.threshold_sweep(study_parts(spark, d)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def unnested(document: DataFrame, part: str, levels: list[str]) -> DataFrame:
    """A row per cell of a document's part: its names by level, and ``v``."""
    rows = document.select(F.explode(part).alias(levels[0], "v"))
    for k in range(1, len(levels)):
        rows = rows.select(*levels[:k], F.explode("v").alias(levels[k], "v"))
    return rows


def named_sql(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


MULTIPLE = {targets.breach(m): str(float(m)) for m in targets.MULTIPLES}
SWEPT = [*SIG, "deep_dd_60"]
SWEPT_CELLS = {
    "sl": unpivot("panel_w", SWEPT, "signal", "s"),
    "cuts": CUTS["cuts"],
    "l": SWEEP["l"],
    "cells": f"""SELECT sl.symbol, sl.signal, q, target, l.week, t, coalesce(s >= cut, false) AS is_on FROM sl JOIN cuts ON sl.symbol = cuts.symbol AND sl.signal = cuts.signal
JOIN l ON l.symbol = sl.symbol AND l.week = sl.week WHERE t IS NOT NULL AND NOT (sl.symbol = '{MARKET}' AND sl.signal = 'beta_60')""",
}
CELL = "symbol, signal, q, target"


def renamed(tables: dict[str, str], suffix: str) -> dict[str, str]:
    """The tables of ``drawn_sql`` under other names, so that two sets of cells can stand in one query."""
    names = ("summed", "runs", "sizes", "taken", "starts", "blocks", "draws")
    swap = lambda sql: re.sub(rf"\b({'|'.join(names)})\b", rf"\1{suffix}", sql)
    return {(f"{k}{suffix}" if k in names else k): swap(v) for k, v in tables.items()}


def sides_sql(names: str) -> str:
    """(point, lo, hi) of each cell's sides, null below 15 rows, from the tables of ``drawn_sql`` by cell and side."""
    p = lambda x: published_sql(f"({x}) * 1e2", 2)
    return f"""SELECT {CELL}, is_on, CASE WHEN n >= 15 THEN {p('t[n + 1] / n')} END AS point, {p('low')} AS lo, {p('high')} AS hi, CASE WHEN n >= 15 THEN n END AS n FROM runs{names}
LEFT JOIN (SELECT {CELL}, is_on, quantile_cont(t / n, 0.05) AS low, quantile_cont(t / n, 0.95) AS high FROM draws{names} GROUP BY {CELL}, is_on) USING ({CELL}, is_on)"""


def diff_sql(names: str) -> str:
    p = lambda x: published_sql(f"({x}) * 1e2", 2)
    enough = "n_on >= 10 AND n - n_on >= 10"
    return f"""SELECT {CELL}, CASE WHEN {enough} THEN {p('a[n + 1] / n_on - (t[n + 1] - a[n + 1]) / (n - n_on)')} END AS point, {p('low')} AS lo, {p('high')} AS hi,
CASE WHEN {enough} THEN n_on END AS n_top, CASE WHEN {enough} THEN n - n_on END AS n_bottom FROM runs{names}
LEFT JOIN (SELECT {CELL}, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM (SELECT *, CASE WHEN k >= 3 AND n - k >= 3 THEN a / k - (t - a) / (n - k) END AS m FROM draws{names} WHERE {enough}) GROUP BY {CELL}) USING ({CELL})"""


SWEEP_CELLS_SQL = with_tables(*PANEL_TABLES, extra=BOTH | since(
    SWEPT_CELLS | renamed(drawn_sql("cells", f"{CELL}, is_on", 15, 8, 1000), "_a") | renamed(drawn_sql("cells", CELL, 20, 8, 1000), "_b")
    | {"sides": sides_sql("_a"), "gap": diff_sql("_b")}
)) + f"""SELECT g.symbol, {named_sql('g.signal', documents.PUBLISHED)} AS signal, {named_sql('g.target', MULTIPLE)} AS mult, CAST(round(g.q * 1e2) AS INTEGER) AS pct, {published_sql('cut', 4)} AS cutoff,
a.point AS top, a.lo AS top_lo, a.hi AS top_hi, a.n AS top_n, b.point AS bottom, b.lo AS bottom_lo, b.hi AS bottom_hi, b.n AS bottom_n, g.point AS diff, g.lo AS diff_lo, g.hi AS diff_hi, g.n_top, g.n_bottom
FROM gap g LEFT JOIN sides a ON a.is_on AND a.symbol = g.symbol AND a.signal = g.signal AND a.q = g.q AND a.target = g.target
LEFT JOIN sides b ON NOT b.is_on AND b.symbol = g.symbol AND b.signal = g.signal AND b.q = g.q AND b.target = g.target
JOIN cuts ON cuts.symbol = g.symbol AND cuts.signal = g.signal AND cuts.q = g.q"""


@query("sweep_document_cells", SWEEP_CELLS_SQL)
def sweep_document_cells(spark: SparkSession, d: str) -> DataFrame:
    """The sweep document taken apart again, a row per fund, signal, multiple and quantile, as published."""
    rows = unnested(documents.threshold_sweep(study_parts(spark, d)), "sweep", ["symbol", "signal", "mult", "pct"])
    side = lambda k: [F.col(f"v.{k}.point").alias(k), F.col(f"v.{k}.lo").alias(f"{k}_lo"), F.col(f"v.{k}.hi").alias(f"{k}_hi")]
    counts = [F.col("v.top.n").alias("top_n"), F.col("v.bottom.n").alias("bottom_n"), F.col("v.diff.n_top").alias("n_top"), F.col("v.diff.n_bottom").alias("n_bottom")]
    return rows.select("symbol", "signal", "mult", F.col("pct").cast("int").alias("pct"), F.col("v.cutoff").alias("cutoff"), *side("top"), *side("bottom"), *side("diff"), *counts)


FOREST_NAMES = {k: v for k, v in documents.FOREST.items()}
FOREST_CELL = "symbol, condition, target"


def forest_sql() -> str:
    p = lambda x: published_sql(f"({x}) * 1e2", 3)
    return f"""SELECT 'forest' AS part, symbol, condition AS name, {named_sql('target', FOREST_NAMES)} AS key, {p('a[n + 1] / n_on - (t[n + 1] - a[n + 1]) / (n - n_on)')} AS x, {p('low')} AS lo, {p('high')} AS hi, n_on AS n FROM runs
JOIN (SELECT {FOREST_CELL}, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM (SELECT *, CASE WHEN k >= 3 AND n - k >= 3 THEN a / k - (t - a) / (n - k) END AS m FROM draws) GROUP BY {FOREST_CELL}) USING ({FOREST_CELL})
WHERE n_on >= 10 AND n - n_on >= 10"""


RATE_NAMES = MULTIPLE
RESEARCH_CELLS_SQL = with_tables(*PANEL_TABLES, extra=BOTH | since(
    COND | {"l": unpivot("targets_w", list(documents.FOREST), "target", "t"), "fc": "SELECT symbol, week, condition, target, t, is_on FROM on1 JOIN l USING (symbol, week) WHERE t IS NOT NULL"}
    | drawn_sql("fc", FOREST_CELL, 20, 8, 1500) | {
        "br": unpivot("targets_w", BREACHES, "target", "t"),
        "rate": "SELECT symbol, target, avg(t) * 1e2 AS rate FROM br GROUP BY 1, 2",
        "tail": "SELECT symbol, median(upside_tail) * 1e2 AS tail FROM targets_w GROUP BY 1",
        "nw": f"SELECT symbol, count(*) FILTER (WHERE {' OR '.join(f'{c} IS NOT NULL' for c in SWEPT)}) AS n FROM panel_w GROUP BY 1",
    }
)) + forest_sql() + f"""
UNION ALL SELECT 'breach_rates', symbol, '', {named_sql('target', RATE_NAMES)}, {published_sql('rate', 1)}, NULL, NULL, NULL FROM rate
UNION ALL SELECT 'breach_rates', symbol, '', 'median_upside_tail', {published_sql('tail', 2)}, NULL, NULL, NULL FROM tail
""" + "".join(f"""UNION ALL SELECT 'cutoffs', symbol, '', '{name}', "cut_{name}", NULL, NULL, NULL FROM cc
""" for name, *_ in study.CUTOFFS) + """UNION ALL SELECT 'vol_tercile', symbol, '', '', "cut_vol_hi_tercile", NULL, NULL, NULL FROM cc
UNION ALL SELECT 'n_weekly_obs', symbol, '', '', NULL, NULL, NULL, n FROM nw"""


@query("research_document_cells", RESEARCH_CELLS_SQL)
def research_document_cells(spark: SparkSession, d: str) -> DataFrame:
    """The research document taken apart again, a row per cell as published, but for the rank correlations (``block_bootstrap_ic``)."""
    doc = staged(documents.research(study_parts(spark, d), SINCE), "research")
    none, text = F.lit(None).cast("double"), F.lit("")

    def part(name: str, levels: list[str], x: Column, lo: Column = none, hi: Column = none, n: Column = none.cast("long")) -> DataFrame:
        rows = unnested(doc, name, levels)
        at = lambda k: F.col(k) if k in levels else text
        return rows.select(F.lit(name).alias("part"), at("symbol").alias("symbol"), at("name").alias("name"), at("key").alias("key"), x.alias("x"), lo.alias("lo"), hi.alias("hi"), n.alias("n"))

    v = F.col("v")
    out = part("forest", ["symbol", "name", "key"], F.col("v.point"), F.col("v.lo"), F.col("v.hi"), F.col("v.n")).where("x is not null")
    out = out.unionByName(part("breach_rates", ["symbol", "key"], v)).unionByName(part("cutoffs", ["symbol", "key"], v))
    return out.unionByName(part("vol_tercile", ["symbol"], v)).unionByName(part("n_weekly_obs", ["symbol"], none, n=v.cast("long")))
