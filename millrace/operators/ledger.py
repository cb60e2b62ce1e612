"""The account ledger: a fold of orders, expiries, dividends and marks over session tapes.

What doesn't depend on the account - candidate contracts, their quotes, rates,
dividends, gates - is computed for all sessions by set operations and arrives as one
tape row per session. Only the account's own state runs in order, one group per run;
runs of all symbols, strategies, scenarios and parameters fold side by side.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.quotes import FEES, fill, usable
from millrace.session import busy_tasks

# Fixed values of the settlement rules.
EXERCISE_FROM = 0.01
EXPIRY_HAIRCUT = 0.05
LEAST_TIME_VALUE = 0.03
FORCED_EXIT_DTE = 1
BRAKES = ((0.75, 0.0), (0.85, 0.5))
BRAKE_WINDOW = 252
LOT = 100

Key = tuple[dt.date, float, str]  # expiration, strike, option type


class Order(NamedTuple):
    """What to do: buy_option, sell_option, write_put, write_call, close_short, buy_stock or sell_stock."""

    what: str
    count: int = 1
    contract: dict[str, Any] | None = None
    pos_id: int | None = None
    tag: str = ""


@dataclass
class Position:
    pos_id: int
    book: str  # long, put or call: the latter two are short
    key: Key
    count: int
    opened: dict[str, Any]


@dataclass
class View:
    """What a strategy sees in a session."""

    session: dt.date
    spot: float
    rate: float
    brake: float
    candidate: dict[str, Any] | None
    vetoed: bool
    account: Account


Strategy = Callable[[View], list[Order]]


@dataclass
class Account:
    cash: float
    scenario: str = "base"
    shares: int = 0
    basis: float = 0.0
    positions: dict[int, Position] = field(default_factory=dict)
    equity: list[dict] = field(default_factory=list)
    trades: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    last_id: int = 0

    def book(self, name: str) -> list[Position]:
        return [p for p in self.positions.values() if p.book == name]

    @property
    def reserved(self) -> float:
        return sum(p.key[1] * LOT * p.count for p in self.book("put"))

    @property
    def free_cash(self) -> float:
        return self.cash - self.reserved

    @property
    def covered(self) -> int:
        return LOT * sum(p.count for p in self.book("call"))

    # Opening and closing legs.

    def open(self, book: str, today: dt.date, contract: dict, quote: tuple, o: Order, price: float, fee: float) -> None:
        self.last_id += 1
        key = (contract["expiration"], contract["strike"], contract["option_type"])
        leg = {
            "pos_id": self.last_id, "kind": "long" if book == "long" else "short", "open_session": today, "expiration": key[0], "strike": key[1], "option_type": key[2],
            "contracts": o.count, "open_price": price, "open_fee": fee, "tag": o.tag, "open_delta": contract.get("delta"), "open_iv": contract.get("iv"),
            "open_dte": (key[0] - today).days,
        }
        self.positions[self.last_id] = Position(self.last_id, book, key, o.count, leg)

    def close(self, p: Position, day: dt.date, price: float, fee: float, how: str) -> None:
        leg = p.opened
        move = price - leg["open_price"] if p.book == "long" else leg["open_price"] - price
        pnl = round(move * LOT * p.count - leg["open_fee"] - fee, 2)
        self.trades.append(leg | {"close_session": day, "close_price": price, "close_fee": fee, "close_how": how, "pnl": pnl})
        del self.positions[p.pos_id]

    def deliver(self, p: Position, bought: bool) -> None:
        """Exchange the strike for shares."""
        n = LOT * p.count
        self.cash += (-1 if bought else 1) * p.key[1] * n
        self.shares += n if bought else -n
        if bought:
            self.basis = p.key[1]

    # Steps of a session.

    def settle(self, p: Position, closes: dict[dt.date, float]) -> None:
        expiry, strike, kind = p.key
        close = closes.get(expiry) or 0.0
        inside = close - strike if kind == "C" else strike - close
        if p.book == "long":
            value = max(inside - EXPIRY_HAIRCUT, 0.0) if inside >= EXERCISE_FROM else 0.0
            self.cash += value * LOT * p.count
            self.close(p, expiry, value, 0.0, "expiry_forced")
        elif inside < EXERCISE_FROM:
            self.close(p, expiry, 0.0, 0.0, "expired")
        else:
            self.deliver(p, bought=p.book == "put")
            self.close(p, expiry, 0.0, 0.0, "assigned" if p.book == "put" else "called_away")
            name = "put_assignment" if p.book == "put" else "call_assignment"
            self.events.append({"session": expiry, "event": name, "strike": strike, "contracts": p.count})

    def sweep(self, prev: dt.date | None, today: dt.date, dividends: dict[dt.date, float], closes: dict[dt.date, float]) -> None:
        """Dividends and expiries since the last session, day by day, dividends first.

        Positions that expired on the last session's own day settle after all of them.
        """
        since = prev or today - dt.timedelta(days=1)
        due = {p.key[0] for p in self.positions.values() if since < p.key[0] < today}
        for day in sorted(due | {d for d in dividends if since < d <= today}):
            amount = dividends.get(day, 0.0)
            if amount > 0 and self.shares > 0:
                self.cash += amount * self.shares
                self.events.append({"session": day, "event": "dividend", "amount": amount, "shares": self.shares})
            if day < today:
                self.settle_all(lambda p: p.key[0] == day, closes)  # noqa: B023
        self.settle_all(lambda p: p.key[0] < today, closes)

    def settle_all(self, due: Callable[[Position], bool], closes: dict[dt.date, float]) -> None:
        for name in ("long", "put", "call"):
            for p in self.book(name):
                if due(p):
                    self.settle(p, closes)

    def assign_early(self, today: dt.date, spot: float, quotes: dict[Key, tuple], ex_day: dt.date | None, ex_amount: float) -> None:
        """Puts without time value, and calls whose time value a dividend tomorrow exceeds."""
        near = ex_day is not None and (ex_day - today).days <= 1
        for p in [*self.book("put"), *(self.book("call") if near else [])]:
            put = p.book == "put"
            inside = p.key[1] - spot if put else spot - p.key[1]
            quote = quotes.get(p.key)
            if inside <= 0 or quote is None or (not put and p.key[0] <= today):
                continue
            if sum(quote) / 2 - inside < (LEAST_TIME_VALUE if put else ex_amount):
                self.deliver(p, bought=put)
                self.close(p, today, 0.0, 0.0, "early_assigned" if put else "called_away_exdiv")
                self.events.append({"session": today, "event": "early_put_assignment" if put else "exdiv_call_assignment", "strike": p.key[1]})

    def execute(self, o: Order, today: dt.date, spot: float, quotes: dict[Key, tuple]) -> None:
        """Carry out an order, or leave it: without a usable quote, cash or cover nothing happens."""
        if o.what in ("buy_stock", "sell_stock"):
            return self.trade_stock(o, today, spot)
        closing = o.what in ("sell_option", "close_short")
        held = self.positions.get(o.pos_id) if closing else None
        if closing and (held is None or (held.book == "long") != (o.what == "sell_option")):
            return None
        c = o.contract
        key = held.key if held else (c["expiration"], c["strike"], {"write_put": "P", "write_call": "C"}.get(o.what, c["option_type"]))
        sell = o.what in ("sell_option", "write_put", "write_call")
        quote = quotes.get(key)
        if quote is None or not usable(*quote, sell):
            return None
        count = held.count if held else o.count
        price, fee = fill("sell" if sell else "buy", *quote, self.scenario), FEES[self.scenario] * count
        amount = (price if sell else -price) * LOT * count - fee
        if held:
            self.cash += amount
            return self.close(held, today, price, fee, o.tag or "close")
        room = {
            "buy_option": lambda: -amount <= self.free_cash,
            "write_put": lambda: key[1] * LOT * count <= self.free_cash + amount,
            "write_call": lambda: LOT * count <= self.shares - self.covered,
        }[o.what]
        if room():
            self.cash += amount
            book = {"buy_option": "long", "write_put": "put", "write_call": "call"}[o.what]
            self.open(book, today, c | {"option_type": key[2]}, quote, o, price, fee)
        return None

    def trade_stock(self, o: Order, today: dt.date, spot: float) -> None:
        if o.what == "sell_stock":
            n = min(o.count, self.shares)
            if n <= 0 or self.shares - n < self.covered:
                return
            self.cash += spot * n
            row = {"close_session": today, "contracts": n, "open_price": self.basis, "close_price": spot, "pnl": round((spot - self.basis) * n, 2)}
            self.shares -= n
        else:
            n = o.count
            if n <= 0 or spot * n > self.free_cash:
                return
            self.basis = (self.basis * self.shares + spot * n) / (self.shares + n)
            self.shares += n
            self.cash -= spot * n
            row = {"open_session": today, "contracts": n, "open_price": spot}
        self.trades.append({"kind": "stock", "tag": o.tag, "close_how": o.tag or o.what} | row)

    def brake(self) -> float:
        """1, 0.5 or 0 by how far the last mark lies under the highest of the last year's."""
        marks = [r["equity"] for r in self.equity[-BRAKE_WINDOW:]]
        return next((b for share, b in BRAKES if marks and marks[-1] < share * max(marks)), 1.0)

    def mark(self, today: dt.date, spot: float, quotes: dict[Key, tuple]) -> None:
        """Value at mid and at what closing would fetch; a contract without a quote counts nothing."""
        mid = liq = self.cash + self.shares * spot
        for p in self.positions.values():
            bid, ask = quotes.get(p.key, (0.0, 0.0))
            n = LOT * p.count * (1 if p.book == "long" else -1)
            mid += n * (bid + ask) / 2
            liq += n * (bid if p.book == "long" else ask)
        longs = len(self.book("long"))
        self.equity.append({
            "session": today, "equity": round(mid, 2), "equity_liq": round(liq, 2), "cash": round(self.cash, 2), "reserved": round(self.reserved, 2),
            "shares": self.shares, "n_long": longs, "n_short": len(self.positions) - longs,
        })


def fold(tape: Iterable[dict], strategy: Strategy, account: Account) -> Account:
    """Run a strategy over a run's tape rows in session order.

    A row has session, spot, rate, dividends [(day, amount)], closes [(day, close)], next_day,
    next_amount, quotes [(expiration, strike, option_type, bid, ask)], candidate and vetoed.
    """
    prev, prev_rate, closes = None, 0.0, {}
    for row in tape:
        today, spot = row["session"], float(row["spot"])
        closes |= {d: c for d, c in row["closes"]}
        quotes = {(e, k, t): (b, a) for e, k, t, b, a in row["quotes"]}
        if prev is not None:
            account.cash *= 1 + prev_rate * (today - prev).days / 365
        account.sweep(prev, today, dict(row["dividends"]), closes)
        account.assign_early(today, spot, quotes, row.get("next_day"), row.get("next_amount") or 0.0)
        for p in account.book("long"):
            if (p.key[0] - today).days <= FORCED_EXIT_DTE:
                account.execute(Order("sell_option", pos_id=p.pos_id, tag="force_dte"), today, spot, quotes)
        view = View(today, spot, row["rate"], account.brake(), row.get("candidate"), bool(row.get("vetoed")), account)
        for o in strategy(view):
            account.execute(o, today, spot, quotes)
        if account.cash < -1e-6 and not account.shares:
            raise RuntimeError(f"negative cash {account.cash} on {today}")
        account.mark(today, spot, quotes)
        prev, prev_rate = today, row["rate"]
    return account


# Strategies.


def _sweep_cash(v: View) -> list[Order]:
    n = int(v.account.free_cash // v.spot)
    return [Order("buy_stock", n, tag="reinvest" if v.account.shares else "init_buy")] if n > 0 else []


def hold_shares(lots: int = 1) -> Strategy:
    """Keep a fixed number of shares: buy what is missing, all of it or none."""
    return lambda v: [Order("buy_stock", n, tag="init_buy")] if (n := lots * LOT - v.account.shares) > 0 else []


def drip_hold() -> Strategy:
    """Put all cash into whole shares, every session."""
    return _sweep_cash


def covered_calls(lots: int = 1, gated: bool = True) -> Strategy:
    """Refill the shares first; otherwise write calls on what is uncovered, unless vetoed."""

    def run(v: View) -> list[Order]:
        missing = lots * LOT - v.account.shares
        if missing > 0:
            n = min(missing, int(v.account.free_cash // v.spot))
            return [Order("buy_stock", n, tag="reinvest" if v.account.shares else "init_buy")] if n > 0 else []
        n = (v.account.shares - v.account.covered) // LOT
        return [Order("write_call", n, v.candidate, tag="cc_write")] if n > 0 and v.candidate and not (gated and v.vetoed) else []

    return run


def reinvesting_calls(lots: int = 1, gated: bool = True) -> Strategy:
    """Put all cash into shares and keep ``lots`` calls written; the shares held before count."""

    def run(v: View) -> list[Order]:
        write = not v.account.book("call") and v.account.shares >= lots * LOT and v.candidate and not (gated and v.vetoed)
        return _sweep_cash(v) + ([Order("write_call", lots, v.candidate, tag="cc_write")] if write else [])

    return run


STRATEGIES: dict[str, Callable[[], Strategy]] = {
    "buyhold_drip": drip_hold,
    "naive_cc_reinvest": lambda: reinvesting_calls(gated=False),
    "sweep_gated_cc_reinvest": reinvesting_calls,
    "buyhold": lambda: hold_shares(2),
    "covered_call": lambda: covered_calls(2),
}

_LOG = (
    "symbol string, strategy string, scenario string, log string, seq int, session date, equity double, equity_liq double, cash double, reserved double, shares int, n_long int, n_short int, "
    "pos_id int, kind string, open_session date, expiration date, strike double, option_type string, contracts int, open_price double, open_fee double, tag string, open_delta double, "
    "open_iv double, open_dte int, close_session date, close_price double, close_fee double, close_how string, pnl double, event string, amount double"
)
_NAMES = [x.split()[0] for x in _LOG.split(", ")]
_INTS = [x.split()[0] for x in _LOG.split(", ") if x.endswith(" int")]
_OBJECTS = [x.split()[0] for x in _LOG.split(", ") if x.endswith((" date", " string"))]
RUN = ("symbol", "strategy", "scenario")


def run_ledgers(
    tape: DataFrame, runs: DataFrame, initial_shares: int = 200, extra: float = 1.01, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """All runs' equity, trade and event rows in one tagged log; ``runs`` is (symbol, strategy, scenario).

    Every run starts with the cash for ``initial_shares`` at the first session's price, and
    a margin. ``tape`` rows are as ``fold`` takes them; the gate is the column ``vetoed``.
    Sessions before ``start`` and after ``end`` are left out.
    """
    if start is not None:
        tape = tape.where(F.col("session") >= F.lit(start))
    if end is not None:
        tape = tape.where(F.col("session") <= F.lit(end))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        symbol, name, scenario = (part[c].iloc[0] for c in RUN)
        rows = part.sort_values("session").to_dict("records")
        for r in rows:
            r["dividends"] = [(x["day"], x["amount"]) for x in r["dividends"]]
            r["closes"] = [(x["day"], x["close"]) for x in r["closes"]]
            r["quotes"] = [tuple(x[k] for k in ("expiration", "strike", "option_type", "bid", "ask")) for x in r["quotes"]]
            for k in ("next_day", "next_amount", "candidate"):
                r[k] = None if not isinstance(r[k], dict) and pd.isna(r[k]) else r[k]
        account = Account(round(rows[0]["spot"] * initial_shares * extra, 2), scenario)
        fold(rows, STRATEGIES[name](), account)
        out = [dict(x, log=log, seq=i) for log in ("equity", "trades", "events") for i, x in enumerate(getattr(account, log))]
        frame = pd.DataFrame(out, columns=_NAMES).astype({c: "Int32" for c in _INTS})
        for c in _OBJECTS:  # a column without values would pass for numbers
            frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
        return frame.assign(symbol=symbol, strategy=name, scenario=scenario)

    joined = runs.join(tape, "symbol")
    return joined.repartition(busy_tasks(joined), *RUN).groupBy(*RUN).applyInPandas(run, _LOG)


def equity_log(log: DataFrame) -> DataFrame:
    return log.where("log = 'equity'").select(*RUN, "session", "equity", "equity_liq", "cash", "reserved", "shares", "n_long", "n_short")


def trade_log(log: DataFrame) -> DataFrame:
    columns = _NAMES[_NAMES.index("pos_id") : _NAMES.index("pnl") + 1]
    return log.where("log = 'trades'").select(*RUN, "seq", *columns)


def event_log(log: DataFrame) -> DataFrame:
    return log.where("log = 'events'").select(*RUN, "seq", "session", "event", "amount", "shares", "strike", "contracts")


def run_counters(log: DataFrame) -> DataFrame:
    """Closed written calls, calls called away at expiry, and the shares held at the end."""
    return log.groupBy(*RUN).agg(
        F.count_if((F.col("log") == "trades") & (F.col("tag") == "cc_write")).alias("n_calls_written"),
        F.count_if((F.col("log") == "trades") & (F.col("close_how") == "called_away")).alias("n_called_away"),
        F.max_by("shares", F.when(F.col("log") == "equity", F.col("session"))).alias("final_shares"),
    )
