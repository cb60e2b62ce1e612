import datetime as dt

import pandas as pd
import pytest

from millrace.operators import ledger as L
from millrace.operators.ledger import Account, Order, fold

D1, D2, D3, EXP = dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 4), dt.date(2024, 1, 19)
FRI, MON = dt.date(2024, 1, 5), dt.date(2024, 1, 8)


def row(day, spot, quotes=(), **more):
    return {"session": day, "spot": spot, "rate": 0.0, "dividends": [], "closes": [], "quotes": list(quotes)} | more


def q(exp, strike, kind, bid, ask):
    return (exp, strike, kind, bid, ask)


def c(exp, strike, kind):
    return {"expiration": exp, "strike": strike, "option_type": kind}


def script(plan):
    return lambda v: plan.get(v.session, [])


def test_long_round_trip():
    tape = [row(D1, 100, [q(EXP, 100.0, "C", 2.0, 2.1)]), row(D2, 102, [q(EXP, 100.0, "C", 4.0, 4.1)])]
    a = fold(tape, script({D1: [Order("buy_option", 2, c(EXP, 100.0, "C"))], D2: [Order("sell_option", pos_id=1)]}), Account(10_000))
    assert a.cash == pytest.approx(10_000 - 416.40 + 803.60)
    assert a.trades[0]["pnl"] == pytest.approx((4.025 - 2.075) * 200 - 2.80)


def test_expiries_settle_at_the_next_session():
    tape = [row(D1, 100, [q(FRI, 105.0, "C", 0.5, 0.55), q(FRI, 95.0, "C", 5.2, 5.4)]), row(MON, 101, closes=[(FRI, 101.0)])]
    a = fold(tape, script({D1: [Order("buy_option", 1, c(FRI, 105.0, "C")), Order("buy_option", 1, c(FRI, 95.0, "C"))]}), Account(10_000))
    assert {t["strike"]: (t["close_price"], t["close_how"]) for t in a.trades} == {105.0: (0.0, "expiry_forced"), 95.0: (pytest.approx(5.95), "expiry_forced")}


def test_put_assignment_and_cash_security():
    tape = [row(D1, 100, [q(FRI, 100.0, "P", 1.5, 1.6), q(FRI, 200.0, "P", 1.5, 1.6)]), row(MON, 96, closes=[(FRI, 96.0)])]
    orders = [Order("write_put", 1, c(FRI, 200.0, "P")), Order("write_put", 1, c(FRI, 100.0, "P"))]
    a = fold(tape, script({D1: orders}), Account(10_000))
    assert a.shares == 100 and a.basis == 100.0 and a.reserved == 0
    assert a.cash == pytest.approx(10_000 + 152.5 - 0.70 - 10_000)
    assert [e["event"] for e in a.events] == ["put_assignment"] and a.equity[0]["reserved"] == 10_000


def test_early_put_assignment():
    tape = [row(D1, 100, [q(EXP, 95.0, "P", 1.0, 1.1)]), row(D2, 80, [q(EXP, 95.0, "P", 14.98, 15.02)])]
    a = fold(tape, script({D1: [Order("write_put", 1, c(EXP, 95.0, "P"))]}), Account(10_000))
    assert a.shares == 100 and a.trades[0]["close_how"] == "early_assigned"


def test_covered_call_cycle_with_dividend():
    day = dt.date(2024, 1, 10)
    tape = [row(D1, 104, [q(EXP, 105.0, "C", 1.0, 1.1)]), row(dt.date(2024, 1, 22), 108, closes=[(EXP, 108.0)], dividends=[(day, 0.5)])]
    a = fold(tape, script({D1: [Order("write_call", 1, c(EXP, 105.0, "C"))]}), Account(0.0, "base", shares=100, basis=100.0))
    assert a.shares == 0 and a.cash == pytest.approx(102.5 - 0.70 + 50 + 10_500)
    assert [e["event"] for e in a.events] == ["dividend", "call_assignment"]


def test_never_uncovered_and_ex_dividend_call():
    tape = [row(D1, 100, [q(EXP, 95.0, "C", 5.0, 5.02)]), row(D2, 100, [q(EXP, 95.0, "C", 5.0, 5.02)], next_day=D3, next_amount=0.5)]
    a = fold(tape, script({D1: [Order("write_call", 2, c(EXP, 95.0, "C")), Order("write_call", 1, c(EXP, 95.0, "C"))]}), Account(0.0, "optimistic", shares=100))
    assert a.trades[0]["close_how"] == "called_away_exdiv" and a.shares == 0 and len(a.trades) == 1
    b = fold(tape[:1], script({D1: [Order("write_call", 1, c(EXP, 95.0, "C"))]}), Account(0.0))
    assert not b.positions and b.cash == 0


def test_interest_stock_orders_and_forced_exit():
    a = fold([row(D1, 100, rate=0.05), row(D1 + dt.timedelta(10), 100)], script({}), Account(10_000))
    assert a.cash == pytest.approx(10_000 * (1 + 0.05 * 10 / 365))
    tape = [row(D1, 100, [q(D3, 100.0, "C", 2.0, 2.1), q(EXP, 105.0, "C", 1.0, 1.1)]), row(D2, 110, [q(D3, 100.0, "C", 9.9, 10.1), q(EXP, 105.0, "C", 6.0, 6.2)])]
    plan = {
        D1: [Order("buy_stock", 100), Order("buy_stock", 10**6), Order("buy_option", 1, c(D3, 100.0, "C")), Order("write_call", 1, c(EXP, 105.0, "C"))],
        D2: [Order("sell_stock", 50), Order("close_short", pos_id=2), Order("sell_stock", 500, tag="out")],
    }
    a = fold(tape, script(plan), Account(20_000, "stress"))
    hows = [t["close_how"] for t in a.trades]
    assert hows == ["buy_stock", "force_dte", "close", "out"] and a.shares == 0 and not a.positions
    assert a.trades[-1]["pnl"] == 1000.0


def test_strategies_and_brake():
    run = L.reinvesting_calls(gated=True)
    cand = c(EXP, 105.0, "C") | {"delta": 0.25, "iv": 0.2}
    tape = [row(d, 100.0, [q(EXP, 105.0, "C", 1.0, 1.1)], candidate=cand, vetoed=v) for d, v in ((D1, False), (D2, True), (D3, False))]
    a = fold(tape, run, Account(20_200))
    assert [t["tag"] for t in a.trades] == ["init_buy"] and len(a.book("call")) == 1 and a.book("call")[0].opened["open_session"] == D3
    a.equity = [{"equity": 100.0}] * 3 + [{"equity": 84.0}]
    assert a.brake() == 0.5
    a.equity.append({"equity": 70.0})
    assert a.brake() == 0.0
    assert [o.count for o in L.hold_shares(2)(L.View(D1, 10.0, 0, 1, None, False, Account(1.0)))] == [200]


def test_runs_in_parallel_match_folds(spark):
    days = pd.bdate_range("2024-01-02", periods=30)
    data = [("A", d.date(), 100.0 + i, 0.02, [], [], [], None, None, None, False) for i, d in enumerate(days)]
    kinds = (
        "symbol string, session date, spot double, rate double, dividends array<struct<day:date,amount:double>>, closes array<struct<day:date,close:double>>, "
        "quotes array<struct<expiration:date,strike:double,option_type:string,bid:double,ask:double>>, next_day date, next_amount double, "
        "candidate struct<expiration:date,strike:double,option_type:string,delta:double,iv:double,dte:int>, vetoed boolean"
    )
    tape = spark.createDataFrame(data, kinds)
    runs = spark.createDataFrame([("A", s, "base") for s in L.STRATEGIES], "symbol string, strategy string, scenario string")
    got = L.equity_log(L.run_ledgers(tape, runs)).where("strategy = 'buyhold_drip'").orderBy("session").collect()
    alone = fold([row(d.date(), 100.0 + i, rate=0.02) for i, d in enumerate(days)], L.drip_hold(), Account(20_200.0))
    assert [(r.equity, r.shares) for r in got] == [(e["equity"], e["shares"]) for e in alone.equity] and got[0].shares == 202
