"""Moving-block bootstrap.

Means and differences of means need a cell's running sums only: a block that is drawn
adds the difference of two of them, so a draw costs a difference per block. The sums are
columns; only they, an array per cell, meet the generator that gives the blocks' starts.
Rank correlations and other statistics see the drawn rows themselves, a cell at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import busy_tasks


def block_indices(n: int, block: int, draws: int, seed: int) -> np.ndarray:
    """(draws x n) positions: blocks start uniformly and are laid end to end, cut at n."""
    starts = np.random.default_rng(seed).integers(0, max(1, n - block + 1), size=(draws, -(-n // block)))
    return (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis."""
    order = np.argsort(x, axis=-1, kind="stable")
    sorted_ = np.take_along_axis(x, order, -1)
    n = x.shape[-1]
    at = np.broadcast_to(np.arange(n), x.shape)
    new = np.concatenate([np.ones((*x.shape[:-1], 1), bool), sorted_[..., 1:] != sorted_[..., :-1]], -1)
    first = np.maximum.accumulate(np.where(new, at, 0), -1)
    end = np.concatenate([new[..., 1:], np.ones((*x.shape[:-1], 1), bool)], -1)
    last = np.flip(np.minimum.accumulate(np.flip(np.where(end, at, n), -1), -1), -1)
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, -1)
    return out


def rank_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = (_ranks(v) - (v.shape[-1] + 1) / 2 for v in (x, y))
    with np.errstate(all="ignore"):
        return (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))


def _interval(values: np.ndarray, alpha: float) -> tuple[float | None, float | None]:
    good = values[np.isfinite(values)]
    if not len(good):
        return None, None
    low, high = np.quantile(good, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def _per_cell(rows: DataFrame, keys: list[str], each: Callable[[pd.DataFrame], dict | None], columns: str) -> DataFrame:
    """A row per cell from its weeks, of one symbol, in order; none where ``each`` gives None."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        got = each(part.sort_values("week"))
        found = [] if got is None else [[*(part[k].iloc[0] for k in keys), *(got.get(c) for c in names)]]
        return pd.DataFrame(found, columns=[*keys, *names])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.repartition(busy_tasks(rows), *keys).groupBy(*keys).applyInPandas(run, f"{kinds}, {columns}")


def ic_interval(pairs: DataFrame, keys: list[str], block: int = 8, draws: int = 1500, seed: int = 11, alpha: float = 0.10, least: int = 30) -> DataFrame:
    """Rank correlation of (s, t) per cell with its interval; cells with fewer than ``least`` rows are left out."""

    def each(part: pd.DataFrame) -> dict | None:
        if len(part) < least:
            return None
        s, t = part["s"].to_numpy(float), part["t"].to_numpy(float)
        ix = block_indices(len(s), block, draws, seed)
        low, high = _interval(rank_correlation(s[ix], t[ix]), alpha)
        ic = float(rank_correlation(s, t))
        return {"n": len(s), "ic": ic if np.isfinite(ic) else None, "low": low, "high": high}

    return _per_cell(pairs.where("s is not null and t is not null"), keys, each, "n long, ic double, low double, high double")


def running(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """(keys, n, an array per sum): running sums of each cell in the order of its weeks, from 0."""
    w = Window.partitionBy(*keys).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "week", *[x.cast("double").alias(c) for c, x in sums.items()]).repartition(busy_tasks(rows), *keys)
    summed = rows.select(*keys, "week", *[F.sum(c).over(w).alias(c) for c in sums])
    cells = summed.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("week", *sums))).alias("_runs"))
    upto = lambda c: F.concat(F.array(F.lit(0.0)), F.transform("_runs", lambda x: x[c])).alias(c)
    return cells.select(*keys, "n", *[upto(c) for c in sums])


#: Block starts that are drawn at a time.
STARTS = 1 << 21


def drawn_sums(runs: list[np.ndarray], block: int, draws: int, seed: int) -> np.ndarray:
    """(draws x sums): what each draw of n rows adds up to, a difference of running sums per block, the last block cut."""
    n = len(runs[0]) - 1
    k, rng, out = -(-n // block), np.random.default_rng(seed), []
    cut = n - (k - 1) * block
    each = max(1, STARTS // k)
    for at in range(0, draws, each):
        starts = rng.integers(0, max(1, n - block + 1), size=(min(each, draws - at), k))  # one stream, whatever the pieces
        ends = starts + block
        ends[:, -1] = starts[:, -1] + cut
        out.append(np.stack([(r[ends] - r[starts]).sum(axis=1) for r in runs], axis=1))
    return np.concatenate(out)


def _with_intervals(cells: DataFrame, sums: list[str], enough: str, statistic: Callable[[np.ndarray, int], np.ndarray], block: int, draws: int, seed: int, alpha: float) -> DataFrame:
    """Add ``low`` and ``high`` of a statistic of a draw's sums for cells where ``enough`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            lists = [b.column(c) for c in sums]
            ends, values = [x.offsets.to_numpy() for x in lists], [x.flatten().to_numpy() for x in lists]
            for k, ok in enumerate(b.column(enough).to_pylist()):
                runs = [v[e[k] - e[0] : e[k + 1] - e[0]] for e, v in zip(ends, values)]
                found.append(_interval(statistic(drawn_sums(runs, block, draws, seed), len(runs[0]) - 1), alpha) if ok else (None, None))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], [*b.schema.names, "low", "high"])

    return cells.mapInArrow(run, T.StructType([*cells.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("low", "high"))]))


def mean_interval(rows: DataFrame, keys: list[str], block: int = 8, draws: int = 1000, seed: int = 11, alpha: float = 0.10, least: int = 15) -> DataFrame:
    """Mean of t per cell with its interval; blocks run over the cell's own rows."""
    cells = running(rows.where("t is not null"), keys, t=F.col("t")).withColumn("_enough", F.col("n") >= least)
    found = _with_intervals(cells, ["t"], "_enough", lambda s, n: s[:, 0] / n, block, draws, seed, alpha)
    return found.select(*keys, "n", F.when(F.col("_enough"), F.element_at("t", -1) / F.col("n")).alias("mean"), "low", "high")


def difference_interval(
    rows: DataFrame, keys: list[str], block: int = 8, draws: int = 1000, seed: int = 11, alpha: float = 0.10, least: int = 10, least_drawn: int = 3
) -> DataFrame:
    """Mean t where on less mean where off per cell, resampled in pairs along the calendar."""
    on, t = F.col("on"), F.col("t")
    cells = running(rows.where("t is not null"), keys, t=t, a=F.when(on, t).otherwise(0.0), k=on)
    cells = cells.withColumn("n_on", F.element_at("k", -1).cast("long")).withColumn("n_off", F.col("n") - F.col("n_on"))
    cells = cells.withColumn("_enough", (F.col("n_on") >= least) & (F.col("n_off") >= least))

    def apart(s: np.ndarray, n: int) -> np.ndarray:
        total, above, many = s.T
        ok = (many >= least_drawn) & (n - many >= least_drawn)
        return above[ok] / many[ok] - (total - above)[ok] / (n - many[ok])

    found = _with_intervals(cells, ["t", "a", "k"], "_enough", apart, block, draws, seed, alpha)
    above = F.element_at("a", -1)
    point = F.when(F.col("_enough"), above / F.col("n_on") - (F.element_at("t", -1) - above) / F.col("n_off"))
    return found.select(*keys, "n_on", "n_off", point.alias("diff"), "low", "high")


def statistic_intervals(
    rows: DataFrame, keys: list[str], stat: Callable = np.mean, block: int = 10, draws: int = 2000, alpha: float = 0.05, seed: int = 7
) -> DataFrame:
    """(keys, n, low, high) of any statistic of t per cell, in the order of weeks; null bounds below five values."""

    def each(part: pd.DataFrame) -> dict:
        low, high = statistic_interval(part["t"].to_numpy(float), stat, block, draws, alpha, seed)
        return {"n": len(part), "low": low if np.isfinite(low) else None, "high": high if np.isfinite(high) else None}

    return _per_cell(rows.where("t is not null"), keys, each, "n long, low double, high double")


def statistic_interval(x: np.ndarray, stat: Callable = np.mean, block: int = 10, draws: int = 2000, alpha: float = 0.05, seed: int = 7) -> tuple[float, float]:
    """Interval of any statistic of a series; NaN below five values."""
    if len(x) < 5:
        return float("nan"), float("nan")
    values = np.apply_along_axis(stat, 1, np.asarray(x)[block_indices(len(x), block, draws, seed)])
    return float(np.quantile(values, alpha / 2)), float(np.quantile(values, 1 - alpha / 2))


def relational(rows: DataFrame, keys: list[str], block: int = 8, draws: int = 1000, seed: int = 11) -> DataFrame:
    """Resampled rows (keys, draw, position, and all columns) as a join on positions.

    Starts come from fixed arithmetic instead of a generator's stream, so any SQL
    engine draws the same: start = (draw * 7919 + j * 104729 + seed) mod (n - block + 1).
    """
    numbered = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("week")) - 1)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    places = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    j = F.floor(F.col("k") / block)
    start = (F.col("draw") * 7919 + j * 104729 + seed) % F.greatest(F.lit(1), F.col("n") - block + 1)
    drawn = places.select(*keys, "draw", (start + F.col("k") % block).cast("int").alias("pos"))
    return drawn.join(numbered, [*keys, "pos"])
