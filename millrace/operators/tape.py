"""Session tapes: everything a run needs in a session, computed for all sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.calendar import as_of, next_event
from millrace.operators.selection import held_quotes


def session_tape(
    chain: DataFrame, closes: DataFrame, rates: DataFrame, dividends: DataFrame, candidates: DataFrame | None, vetoes: DataFrame | None, whole_chain: bool = False
) -> DataFrame:
    """One row per (symbol, session) that has quotes.

    With ``candidates`` only their quotes, from the session they are picked to their
    expiry, ride along; a strategy that picks contracts itself needs ``whole_chain``.
    """
    by = ["symbol", "session"]
    days = chain.groupBy(*by).agg(F.max("spot").alias("spot"))
    prev = F.lag("session").over(Window.partitionBy("symbol").orderBy("session"))
    days = days.withColumn("prev", prev)
    tape = as_of(days, rates, "rate", "session", "date").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    tape = next_event(tape, dividends, "session", "ex_date", "amount")

    # Dividends and expiries belong to the session whose gap (prev, session] they fall in.
    gaps = days.select("symbol", "session", F.explode(F.sequence(F.coalesce(F.date_add("prev", 1), F.col("session")), F.col("session"))).alias("day"))
    paid = dividends.groupBy("symbol", F.col("ex_date").alias("day")).agg(F.sum("amount").alias("amount"))
    paid = gaps.join(paid, ["symbol", "day"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("day", "amount"))).alias("dividends"))
    quotes = chain if candidates is None or whole_chain else None
    if quotes is None:
        held = candidates.select("symbol", F.col("session").alias("opened"), "expiration", "strike", "option_type").distinct()
        quotes = held_quotes(held, chain)
    quote = F.struct("expiration", "strike", "option_type", "bid", "ask")
    quotes = quotes.groupBy(*by).agg(F.array_sort(F.collect_set(quote)).alias("quotes"))
    expiries = chain.select("symbol", F.col("expiration").alias("day")).distinct()
    settled = as_of(expiries, closes, "close", "day", "date", ("symbol",))
    # The first session after an expiry, by one sort of both.
    following = days.select("symbol", "session", F.lit(0.0).alias("nothing"))
    settled = next_event(settled, following, "day", "session", "nothing").where("next_day is not null").withColumnRenamed("next_day", "session")
    settled = settled.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("day", "close"))).alias("closes"))
    for part in (paid, quotes, settled):
        tape = tape.join(part, by, "left")
    if candidates is not None:
        pick = F.struct("expiration", "strike", "option_type", "delta", "iv", "dte").alias("candidate")
        tape = tape.join(candidates.select(*by, pick), by, "left")
    else:
        tape = tape.withColumn("candidate", F.lit(None).cast("struct<expiration:date,strike:double,option_type:string,delta:double,iv:double,dte:int>"))
    if vetoes is not None:
        tape = as_of(tape, vetoes, "vetoed", "session", "date", ("symbol",))
    else:
        tape = tape.withColumn("vetoed", F.lit(False))
    none = {"dividends": "array<struct<day:date,amount:double>>", "closes": "array<struct<day:date,close:double>>"}
    for c, kind in none.items():
        tape = tape.withColumn(c, F.coalesce(F.col(c).cast(kind), F.array().cast(kind)))
    empty = F.array().cast("array<struct<expiration:date,strike:double,option_type:string,bid:double,ask:double>>")
    return tape.withColumn("quotes", F.coalesce("quotes", empty)).drop("prev")
