"""Signals: lagged, look-ahead-free features of daily series.

All windows of a symbol share one partitioning and order, so they need one exchange
and one sort. Series are pre-aggregated to a row a day before they get here.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.frames import ADDED, with_frame_ranks
from millrace.functions.windows import change, flag, ordered, rolling
from millrace.operators.calendar import on_calendar

TRADING_DAYS = 252


def returns(px: DataFrame, lags: tuple[int, ...] = (1, 5, 21, 84)) -> DataFrame:
    return px.select("symbol", "date", *[change(F.col("close"), ordered(), k).alias(f"ret{k}") for k in lags])


def with_rsi(px: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength with simple averages; null when a window has no losses."""
    move = F.col("close") - F.lag("close", 1).over(ordered())
    up, down = (F.when(move.isNotNull(), F.greatest(x, F.lit(0.0))) for x in (move, -move))
    rows = px.withColumn("_up", up).withColumn("_down", down)
    ratio = F.try_divide(rolling(F.avg, F.col("_up"), ordered(), n), F.nullif(rolling(F.avg, F.col("_down"), ordered(), n), F.lit(0.0)))
    return rows.withColumn(f"rsi{n}", 100.0 - F.lit(100.0) / (ratio + 1.0)).drop("_up", "_down")


def with_averages(px: DataFrame) -> DataFrame:
    """20- and 200-day averages, and whether the price is above the latter and its bands."""
    c = F.col("close")
    rows = px.withColumn("ma20", rolling(F.avg, c, ordered(), 20)).withColumn("ma200", rolling(F.avg, c, ordered(), 200))
    return rows.select(
        "*",
        flag(c > F.col("ma200")).alias("above_ma200"),
        flag(c > F.col("ma200") * 1.01).alias("above_ma200_up"),
        flag(c > F.col("ma200") * 0.99).alias("above_ma200_dn"),
    )


def with_volatility(px: DataFrame, n: int = 20) -> DataFrame:
    rows = px.withColumn("ret1", change(F.col("close"), ordered(), 1))
    return rows.withColumn(f"rv{n}", rolling(F.stddev_samp, F.col("ret1"), ordered(), n) * F.sqrt(F.lit(float(TRADING_DAYS))))


def with_drawdown(px: DataFrame, n: int = TRADING_DAYS, least: int = 60, deepest: int = 60) -> DataFrame:
    """Drawdown from the rolling high, and its minimum over the last ``deepest`` rows."""
    c = F.col("close")
    rows = px.withColumn("dd", c / rolling(F.max, c, ordered(), n, least) - 1.0)
    return rows.withColumn(f"deep_dd_{deepest}", rolling(F.min, F.col("dd"), ordered(), deepest))


def with_return_percentile(px: DataFrame, k: int = 21, n: int = 756, least: int = 252) -> DataFrame:
    """Average-rank percentile of the k-day return within its last n rows."""
    rows = with_frame_ranks(px.withColumn(f"ret{k}", change(F.col("close"), ordered(), k)), f"ret{k}", n)
    rank = (F.col("_below") + (F.col("_same") + 1) / 2.0) / F.col("_known")
    return rows.withColumn(f"ret{k}_pctile", F.when(F.col("_known") >= least, rank)).drop(*ADDED)


def with_share_below(rows: DataFrame, value: str, name: str, n: int = TRADING_DAYS, least: int = 100, by: str = "symbol") -> DataFrame:
    """Share of the last n rows strictly below the current value; null rows count in the denominator."""
    ranked = with_frame_ranks(rows, value, n, by)
    # A current null is below nothing.
    share = F.coalesce(F.col("_below"), F.lit(0)) / F.col("_rows")
    return ranked.withColumn(name, F.when(F.col("_known") >= least, share)).drop(*ADDED)


class _Products:
    """Sums over a moving frame of the values, squares and cross products of returns, for every pair of series where both are known."""

    def __init__(self, n: int) -> None:
        self.n, self.names, self.held = n, [], deque()
        self.sums = self.lost = np.zeros((4, 0, 0))

    def _moved(self, row: np.ndarray, sign: int) -> None:
        """Add a row of returns to the sums or take it out; what rounding loses is kept beside them."""
        known = ~np.isnan(row)
        x = np.where(known, row, 0.0)
        terms = sign * np.stack([np.outer(known, known), np.outer(x, known), np.outer(x * x, known), np.outer(x, x)]).astype(float)
        total = self.sums + terms
        self.lost = self.lost + np.where(np.abs(self.sums) >= np.abs(terms), (self.sums - total) + terms, (terms - total) + self.sums)
        self.sums = total

    def widened(self, name: str) -> int:
        """The place of a series, a new one if need be."""
        if name not in self.names:
            self.names.append(name)
            self.sums, self.lost = (np.pad(s, ((0, 0), (0, 1), (0, 1))) for s in (self.sums, self.lost))
            self.held = deque(np.append(r, np.nan) for r in self.held)
        return self.names.index(name)

    def mean_correlation(self, row: np.ndarray) -> float | None:
        """Move on by a row; the mean over pairs with a full frame of their correlation."""
        self.held.append(row)
        self._moved(row, 1)
        if len(self.held) > self.n:
            self._moved(self.held.popleft(), -1)
        count, a, aa, ab = self.sums + self.lost
        with np.errstate(all="ignore"):
            spread = aa - a * a / count  # of the row's series over the days on which the column's is known too
            corr = (ab - a * a.T / count) / np.sqrt(spread * spread.T)
        # A constant series leaves rounding alone; its squares tell how much that may be.
        live = (count >= self.n) & (spread > 1e-12 * aa) & (spread.T > 1e-12 * aa.T)
        found = corr[np.triu(live, 1)]
        return float(found.mean()) if len(found) else None


def pairwise_correlation(sectors: DataFrame, n: int = 60) -> DataFrame:
    """(date, corr): mean over all sector pairs of the rolling correlation of returns.

    Returns are taken on the union of all sectors' days, gaps filled forward. The days, an
    array of closes each, stream in order through one task that holds a frame of them:
    market-wide daily series are a row a day whatever the size of the tables behind them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, last = _Products(n), np.zeros(0)
        for b in batches:
            found = []
            for day in b.column("closes").to_pylist():
                places = [products.widened(x["sector"]) for x in day]
                last = np.append(last, np.full(len(products.names) - len(last), np.nan))
                now = last.copy()
                for k, x in zip(places, day):
                    if x["close"] is not None:
                        now[k] = x["close"]
                with np.errstate(all="ignore"):
                    change = now / last - 1.0
                found.append(products.mean_correlation(np.where(np.isfinite(change), change, np.nan)))
                last = now
            yield pa.RecordBatch.from_arrays([b.column("date"), pa.array(found, pa.float64())], ["date", "corr"])

    days = sectors.groupBy("date").agg(F.collect_list(F.struct("sector", F.col("close").cast("double").alias("close"))).alias("closes"))
    return days.repartition(1).sortWithinPartitions("date").mapInArrow(run, T.StructType([sectors.schema["date"], T.StructField("corr", T.DoubleType())]))


def rolling_beta(px: DataFrame, market: str, n: int = 60) -> DataFrame:
    """Beta to the market's returns on the same days; the market's own is 1."""
    r = returns(px, (1,))
    m = r.where(F.col("symbol") == market).select("date", F.col("ret1").alias("rm"))
    rows = r.join(m, "date", "left")
    both = F.col("ret1").isNotNull() & F.col("rm").isNotNull()
    rows = rows.withColumn("x", F.when(both, F.col("ret1"))).withColumn("y", F.when(both, F.col("rm")))
    frame = ordered().rowsBetween(-(n - 1), 0)
    beta = F.try_divide(F.covar_samp("x", "y").over(frame), F.nullif(F.var_samp("y").over(frame), F.lit(0.0)))
    beta = F.when(F.col("symbol") == market, 1.0).otherwise(F.when(F.count("x").over(frame) >= n, beta))
    return rows.select("symbol", "date", beta.alias(f"beta_{n}"))


def absorption_shift(eigen: DataFrame, k: int = 20) -> DataFrame:
    """(date, absorption_shift): change over k rows of the feature's own calendar."""
    w = Window.orderBy("date")  # one market-wide series, a row a day
    return eigen.select("date", (F.col("ar1") - F.lag("ar1", k).over(w)).alias("absorption_shift"))


def lagged(panel: DataFrame) -> DataFrame:
    """Every feature one row later, so that a row holds what was known the day before."""
    return panel.select("symbol", "date", *[F.lag(c, 1).over(ordered()).alias(c) for c in panel.columns if c not in ("symbol", "date")])


def signal_panel(px: DataFrame, sectors: DataFrame, vol: DataFrame, eigen: DataFrame) -> DataFrame:
    """The traded signals by symbol and day, lagged by one row."""
    rows = px.withColumn("px", F.col("close"))
    for k in (1, 5, 21, 84):
        rows = rows.withColumn(f"ret{k}", change(F.col("close"), ordered(), k))
    rows = with_drawdown(with_averages(with_rsi(rows)))
    rows = with_return_percentile(rows)
    rows = rows.withColumn("rv20", rolling(F.stddev_samp, F.col("ret1"), ordered(), 20) * F.sqrt(F.lit(252.0)))
    for series, value, name in ((pairwise_correlation(sectors), "corr", "sector_corr_60"), (vol, "value", "vol_own"), (absorption_shift(eigen), "absorption_shift", "absorption_shift")):
        rows = on_calendar(rows, series.withColumnRenamed(value, name), name)
    return lagged(rows.drop("close"))


SIGNALS = ("rsi14", "sector_corr_60", "trend_84d", "px_vs_ma200", "absorption_shift", "vol_own", "vol_rank_252", "vrp_proxy", "deep_dd_60", "beta_60")


def research_panel(px: DataFrame, sectors: DataFrame, vol: DataFrame, eigen: DataFrame, market: str) -> DataFrame:
    """The researched signals by symbol and day, lagged by one row."""
    c = F.col("close")
    rows = with_drawdown(with_volatility(with_averages(with_rsi(px))))
    rows = rows.withColumn("trend_84d", change(c, ordered(), 84)).withColumn("px_vs_ma200", c / F.col("ma200") - 1.0)
    for series, value, name in ((pairwise_correlation(sectors), "corr", "sector_corr_60"), (absorption_shift(eigen), "absorption_shift", "absorption_shift"), (vol, "value", "vol_own")):
        rows = on_calendar(rows, series.withColumnRenamed(value, name), name)
    rows = with_share_below(rows, "vol_own", "vol_rank_252").withColumn("vrp_proxy", F.col("vol_own") / 100.0 - F.col("rv20"))
    rows = rows.join(rolling_beta(px, market), ["symbol", "date"], "left")
    return lagged(rows.select("symbol", "date", *SIGNALS))
