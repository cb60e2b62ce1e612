"""Option pricing as Column expressions, and a solver of implied volatilities in columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.windows import computed

YEAR = 365.0
VOL_RANGE = (1e-4, 5.0)

# The rational approximation of the normal tail (Hart 1968, as given by West 2005).
TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_EDGE, TAIL_SCALE = 7.07106781186547, 2.506628274631
SQRT_2PI = 2.5066282746310002


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / SQRT_2PI


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often it is mentioned.

    Written out, the pricing formulas mention their inner terms dozens of times and
    outgrow what a compiled method may hold.
    """
    return F.transform(F.array(x), use)[0]


def plain_cdf(x: Column) -> Column:
    """``norm_cdf`` of a column, which mentions it many times."""
    a = F.abs(x)
    z = F.exp(-a * a / 2.0)
    poly = lambda cs: reduce(lambda acc, c: acc * a + c, cs[1:], F.lit(cs[0]))
    far = a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + 0.65))))
    tail = F.when(a > 37.0, 0.0).when(a < TAIL_EDGE, z * poly(TAIL_TOP) / poly(TAIL_BOTTOM)).otherwise(z / far / TAIL_SCALE)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def norm_cdf(x: Column) -> Column:
    """The normal distribution function, to 2e-16."""

    return bound(x, plain_cdf)


def year_fraction(expiration: Column, day: Column) -> Column:
    return F.greatest(F.datediff(expiration, day), F.lit(0)) / F.lit(YEAR)


def forward_price(spot: Column, t: Column, r: Column, q: Column) -> Column:
    return spot * F.exp((r - q) * t)


def _d1(fwd: Column, strike: Column, t: Column, vol: Column) -> Column:
    return (F.log(fwd / strike) + vol * vol * t / 2.0) / (vol * F.sqrt(t))


def black76_price(fwd: Column, strike: Column, t: Column, vol: Column, df: Column, call: Column) -> Column:
    """Discounted value on a forward; without time or volatility, discounted intrinsic value."""
    sign = F.when(call, 1.0).otherwise(-1.0)
    intrinsic = df * F.greatest(sign * (fwd - strike), F.lit(0.0))
    live = bound(_d1(fwd, strike, t, vol), lambda d1: df * sign * (fwd * norm_cdf(sign * d1) - strike * norm_cdf(sign * (d1 - vol * F.sqrt(t)))))
    return F.when((t <= 0) | (vol <= 0), intrinsic).otherwise(live)


def bs_price(spot: Column, strike: Column, t: Column, vol: Column, r: Column, q: Column, call: Column) -> Column:
    fwd = F.when(t <= 0, spot).otherwise(forward_price(spot, t, r, q))
    return black76_price(fwd, strike, t, vol, F.exp(-r * F.greatest(t, F.lit(0.0))), call)


def bs_greeks(spot: Column, strike: Column, t: Column, vol: Column, r: Column, q: Column, call: Column) -> Column:
    """Struct of delta, gamma, vega, theta (a year) and rho; a step delta and zeros when degenerate."""
    sign = F.when(call, 1.0).otherwise(-1.0)
    flat = (t <= 0) | (vol <= 0)
    grow, disc, root = F.exp(-q * t), F.exp(-r * t), F.sqrt(t)

    def live(d1: Column) -> Column:
        near = F.struct(norm_cdf(sign * d1).alias("n1"), norm_cdf(sign * (d1 - vol * root)).alias("n2"), norm_pdf(d1).alias("pdf"))
        return bound(near, lambda n: F.struct(
            (sign * grow * n["n1"]).alias("delta"),
            (grow * n["pdf"] / (spot * vol * root)).alias("gamma"),
            (spot * grow * n["pdf"] * root).alias("vega"),
            (-spot * grow * n["pdf"] * vol / (2.0 * root) - sign * r * strike * disc * n["n2"] + sign * q * spot * grow * n["n1"]).alias("theta"),
            (sign * strike * t * disc * n["n2"]).alias("rho"),
        ))

    step = F.when(sign * (spot - strike) > 0, sign).otherwise(0.0)
    none = [F.lit(0.0).alias(k) for k in ("gamma", "vega", "theta", "rho")]
    return F.when(flat, F.struct(step.alias("delta"), *none)).otherwise(bound(_d1(forward_price(spot, t, r, q), strike, t, vol), live))


def per_day_theta(theta: Column) -> Column:
    return theta / YEAR


def no_arb_bounds(spot: Column, strike: Column, t: Column, r: Column, q: Column, call: Column) -> Column:
    """Struct (low, high) of the prices that admit no arbitrage."""
    fwd, df = forward_price(spot, t, r, q), F.exp(-r * t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    return F.struct(F.greatest(df * sign * (fwd - strike), F.lit(0.0)).alias("low"), (df * F.when(call, fwd).otherwise(strike)).alias("high"))


#: Third-order steps after the first guess: two are enough near the money, three for all but volatilities of years-long wings.
STEPS = 4


def with_implied_vol(rows: DataFrame, name: str, price: Column, spot: Column, strike: Column, t: Column, r: Column, q: Column, call: Column) -> DataFrame:
    """Add the volatility that gives ``price``; null where the price is out of bounds or has none in range.

    The price is turned into the time value of the option that is out of the money, over
    the root of forward times strike: a function of x = -|log(forward / strike)| and of
    s = volatility times root time alone. Where that admits it the first guess is the root of
    a quadratic that is exact near the money, elsewhere it follows the value at the point
    of inflection, s = sqrt(2 |x|). Steps of third order on the logarithm of the value
    follow, kept between the bounds found so far. Every step is a few columns.
    """
    c = lambda n: F.col(f"_iv_{n}")
    put = lambda rows, /, **columns: rows.withColumns({f"_iv_{n}": v for n, v in columns.items()})

    def apart(rows: DataFrame, **columns: Column) -> DataFrame:
        """Like ``put``, as a step that is compiled by itself: a higher-order function, here one that changes nothing, ends
        the compiled stage. All steps in one would make a method beyond what the JVM compiles to machine code."""
        return put(rows, ok=F.transform(F.array(c("ok")), lambda x: x)[0], **columns)

    def valued(rows: DataFrame, s: Column) -> DataFrame:
        """Add the value at s and its slope."""
        rows = put(rows, up=c("x") / s + s / 2.0, down=c("x") / s - s / 2.0)
        slope = F.exp(-(c("x") * c("x") / (s * s) + s * s / 4.0) / 2.0) / SQRT_2PI
        rows = apart(rows, up=plain_cdf(c("up")), down=plain_cdf(c("down")), slope=F.greatest(slope, F.lit(1e-300)))
        return put(rows, b=F.greatest(c("w") * c("up") - c("down") / c("w"), F.lit(1e-300)))

    fwd, sign = F.when(t > 0, spot * F.exp((r - q) * t)), F.when(call, 1.0).otherwise(-1.0)
    rows = put(rows, price=price, strike=strike, fwd=fwd, df=F.exp(-r * t), sign=sign, root=F.sqrt(F.greatest(t, F.lit(0.0))))
    low, high = F.greatest(c("df") * c("sign") * (c("fwd") - c("strike")), F.lit(0.0)), c("df") * F.when(c("sign") > 0, c("fwd")).otherwise(c("strike"))
    rows = put(rows, low=low, ok=(c("price") > 0) & (c("fwd") > 0) & (c("strike") > 0) & (c("price") <= high + 1e-12))
    value = F.try_divide(c("price") - c("low"), c("df") * F.sqrt(c("fwd") * c("strike")))
    rows = put(rows, ok=F.coalesce(c("ok") & (value > 0), F.lit(False)), x=-F.abs(F.log(F.try_divide(c("fwd"), c("strike")))), v=value)
    # Where there is nothing to solve, plain numbers keep the steps defined.
    rows = put(rows, x=F.when(c("ok"), c("x")).otherwise(-0.1), v=F.when(c("ok"), c("v")).otherwise(0.1))
    rows = put(rows, w=F.exp(c("x") / 2.0), s=F.sqrt(F.greatest(-2.0 * c("x"), F.lit(1e-18))), wing=F.sinh(-c("x") / 2.0), lo=F.lit(1e-9), hi=F.lit(100.0))
    rows = put(valued(rows, c("s")), near=c("v") + c("wing"))
    disc = c("near") * c("near") - 4.0 / math.pi * c("wing") * c("wing")
    close = math.sqrt(2 * math.pi) / (c("w") + 1.0 / c("w")) * (c("near") + F.sqrt(F.greatest(disc, F.lit(0.0))))
    far = F.sqrt(F.try_divide(c("x") * c("x") / 2.0, F.greatest(-c("x") / 4.0 + F.log(c("b") / c("v")), F.lit(0.0))))
    guess = F.when((disc >= 0) & (c("v") < c("b") + 0.3), close).when(c("v") < c("b"), far).otherwise(c("s") + (c("v") - c("b")) / c("slope"))
    rows = put(rows, s=F.greatest(c("lo"), F.least(c("hi"), F.coalesce(guess, c("s")))))
    for _ in range(STEPS):
        rows = valued(rows, c("s"))
        under = c("b") < c("v")
        square = c("x") * c("x") / (c("s") * c("s"))
        turn, rate = square / c("s") - c("s") / 4.0, c("slope") / c("b")
        rows = put(rows, lo=F.when(under, c("s")).otherwise(c("lo")), hi=F.when(under, c("hi")).otherwise(c("s")), g1=F.log(c("v") / c("b")) * c("b") / c("slope"), turn=turn, rate=rate, third=turn * turn - 3.0 * square / (c("s") * c("s")) - 0.25)
        g2, g3 = c("turn") - c("rate"), c("third") - 3.0 * c("turn") * c("rate") + 2.0 * c("rate") * c("rate")
        rows = put(rows, new=c("s") + F.try_divide(c("g1") * (1.0 + g2 * c("g1") / 2.0), 1.0 + g2 * c("g1") + g3 * c("g1") * c("g1") / 6.0))
        held = (c("new") >= c("lo") * (1 - 1e-9)) & (c("new") <= c("hi") * (1 + 1e-9))
        rows = apart(rows, s=F.when(held, c("new")).otherwise(F.sqrt(c("lo") * c("hi"))))
    # A step that filters are not pushed below, or they would be written out in terms of all the columns above.
    own = [x for x in rows.columns if not x.startswith("_iv_") and x != name]
    rows = computed(rows, _iv_vol=F.when(c("ok"), F.try_divide(c("s"), c("root"))))
    in_range = c("vol").between(VOL_RANGE[0] * (1 - 1e-9), VOL_RANGE[1] * (1 + 1e-9))
    return rows.select(*[F.col(f"`{x}`") for x in own], F.when(in_range, c("vol")).alias(name))


def bisected_vol(price: Column, spot: Column, strike: Column, t: Column, r: Column, q: Column, call: Column, steps: int = 50) -> Column:
    """Bisection as one expression, for cross-checks; slow, as it is interpreted."""
    start = F.struct(F.lit(VOL_RANGE[0]).alias("a"), F.lit(VOL_RANGE[1]).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2.0
        over = bs_price(spot, strike, t, mid, r, q, call) > price
        return F.struct(F.when(over, s["a"]).otherwise(mid).alias("a"), F.when(over, mid).otherwise(s["b"]).alias("b"))

    bounds = no_arb_bounds(spot, strike, t, r, q, call)
    ok = (t > 0) & (price > 0) & (spot > 0) & (strike > 0) & (price >= bounds["low"] - 1e-12) & (price <= bounds["high"] + 1e-12)
    vol = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2.0)
    return F.when(ok, vol)
