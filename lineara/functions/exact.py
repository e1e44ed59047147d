"""Exact arithmetic on decimals of 38 digits: prices are pairs of whole numbers and never floats.

Where a product would leave 38 digits the result is null or false, as it can't be proven.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUANTUM = 1_000_000  # the program's own step of value
MAX_GROWTH_PPM = 10
MIN_PRICEABLE = 100_000_000
FEES_BPS = {"creator": 25, "platform": 90, "dev": 10}
DEV_FLOOR = 20_000_000
BPS = 10_000


def whole(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")


def times(a: Column, b: Column) -> Column:
    return F.try_multiply(whole(a), whole(b)).cast("decimal(38,0)")


def plus(a: Column, b: Column) -> Column:
    return F.try_add(whole(a), whole(b)).cast("decimal(38,0)")


def minus(a: Column, b: Column) -> Column:
    return F.try_subtract(whole(a), whole(b)).cast("decimal(38,0)")


def quotient(a: Column, b: Column) -> Column:
    """a / b cut toward zero, for quotients that fit 64 bits; null for a zero divisor or a larger quotient."""
    fits = F.abs(whole(a)) < times(F.abs(whole(b)), F.lit(1 << 62))
    return F.when((b != 0) & fits, F.call_function("div", whole(a), whole(b)))


def ceil_quotient(a: Column, b: Column) -> Column:
    """Smallest whole number not below a / b, for positive a and b."""
    return quotient(minus(plus(a, b), whole(1)), b)


def change_bps(q0: Column, b0: Column, q1: Column, b1: Column) -> Column:
    """Change of the price q / b in whole basis points, cut toward zero; null where a side is nothing."""
    before, after = times(q0, b1), times(q1, b0)
    ok = (b0 > 0) & (q0 > 0) & (b1 > 0)
    return F.when(ok, quotient(times(minus(after, before), whole(BPS)), before))


def bracket_holds(v: Column, k0: Column, k1: Column, b0: Column, b1: Column, quote: Column, base: Column, is_buy: Column, fee_bps: Column) -> Column:
    """Whether a trade's price lies between the curve's marginal prices before and after it, give or take a quantum and the fee kept inside."""
    step = plus(whole(QUANTUM), quotient(times(quote, fee_bps), whole(BPS)))
    low_k, high_k = F.when(is_buy, k0).otherwise(k1), F.when(is_buy, k1).otherwise(k0)
    low_b, high_b = F.when(is_buy, b0).otherwise(b1), F.when(is_buy, b1).otherwise(b0)
    low = times(minus(plus(v, low_k), step), base) <= times(quote, low_b)
    high = times(quote, high_b) <= times(plus(plus(v, high_k), step), base)
    return F.coalesce((base > 0) & (quote > 0) & (b0 > 0) & (b1 > 0) & low & high, F.lit(False))


def invariant_holds(v: Column, k0: Column, k1: Column, b0: Column, b1: Column, quote: Column, fee_bps: Column) -> Column:
    """Whether the product of the reserves doesn't shrink and grows by no more than its rounding, or the fee kept inside, explains."""
    before, after = times(plus(v, k0), b0), times(plus(v, k1), b1)
    growth = minus(after, before)
    exact = times(growth, whole(1_000_000)) <= times(before, whole(MAX_GROWTH_PPM))
    fee = plus(quotient(times(quote, fee_bps), whole(BPS)), whole(QUANTUM))
    pooled = growth <= times(fee, F.greatest(whole(b0), whole(b1)))
    return F.coalesce((after >= before) & F.when(fee_bps == 0, exact).otherwise(pooled), F.lit(False))


def fee_legs(quote: Column, bps: dict[str, int] = FEES_BPS, floor: int = DEV_FLOOR) -> dict[str, Column]:
    """The fee of each leg in whole units; the dev leg has a least amount."""
    legs = {k: quotient(times(quote, whole(x)), whole(BPS)) for k, x in bps.items()}
    return legs | {"dev": F.greatest(legs["dev"], F.lit(floor).cast("long"))}


def quote_buy(v: Column, value: Column, reserve: Column, amount: Column, scale: int = QUANTUM) -> Column:
    """Tokens that ``amount`` buys; null where the amount is no positive multiple of ``scale`` or buys none."""
    left = ceil_quotient(times(plus(v, value), reserve), plus(plus(v, value), amount))
    out = reserve - left
    return F.when((amount > 0) & (amount % scale == 0) & (reserve > 0) & (out > 0), out)


def quote_sell(v: Column, value: Column, reserve: Column, amount: Column, scale: int = QUANTUM) -> Column:
    """Value that selling ``amount`` tokens releases, cut to multiples of ``scale``; null where it is none."""
    least = minus(ceil_quotient(times(plus(v, value), reserve), plus(reserve, amount)), v).cast("long")
    most = value - least
    out = most - most % scale
    return F.when((amount > 0) & (reserve > 0) & (most > 0) & (out > 0), out)


def vested(amount: Column, start: Column, duration: Column | int, now: Column | int) -> Column:
    """Whole units vested at ``now``: nothing before the start, all after the end, linear and cut between."""
    duration, now = (F.lit(x) if isinstance(x, int) else x for x in (duration, now))
    gone = F.least(F.greatest(now - start, F.lit(0)), duration)
    return quotient(times(amount, gone), duration)


def little_endian(b: Column) -> Column:
    """A number of at most eight little-endian bytes; null if it is longer or needs the 64th bit."""
    digits = F.hex(b)
    pairs = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(digits, 2 * i - 1, F.lit(2)))
    number = F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")
    return F.when(F.length(b) == 0, F.lit(0)).when((F.length(b) <= 8) & (number <= F.lit(2**63 - 1)), number.cast("long"))


def scaled(amount: Column, decimals: Column) -> Column:
    """A whole amount with its decimal point set by string operations, without trailing zeros."""
    padded = F.lpad(amount.cast("string"), F.greatest(F.length(amount.cast("string")), decimals + 1), F.lit("0"))
    head = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    tail = F.regexp_replace(F.substring(padded, F.length(padded) - decimals + 1, decimals), "0+$", "")
    return F.when(tail == "", head).otherwise(F.concat_ws(".", head, tail))
