"""How figures, times and bytes are shown or sorted into classes, as native expressions. Times are milliseconds since 1970, UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MS_PER_DAA = 100


def amount(sompi: Column, unit: str) -> Column:
    """An amount of smallest units: whole thousands with commas, cents from one on, up to four places below."""
    whole, cents = F.call_function("div", sompi, F.lit(100_000_000)), F.round((sompi % 100_000_000) / 1e6).cast("long")
    big = F.format_number(F.round(sompi / 1e8).cast("long"), 0)
    mid = F.when(cents == 100, F.concat((whole + 1).cast("string"), F.lit(".00"))).otherwise(F.format_string("%d.%02d", whole, cents))
    small = F.regexp_replace(F.format_string("%.4f", sompi / 1e8), r"\.?0+$", "")
    text = F.when(sompi >= 100_000_000_000, big).when(sompi >= 100_000_000, mid).when(sompi == 0, "0").otherwise(small)
    return F.concat(text, F.lit(f" {unit}"))


def iso_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def shown_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "MMM d, yyyy")


def iso_week(ms: Column) -> Column:
    day = F.to_date(F.timestamp_millis(ms))
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def monday(ms: Column) -> Column:
    return F.date_format(F.date_trunc("week", F.timestamp_millis(ms)), "yyyy-MM-dd")


def daa_to_ms(daa: Column, anchor_daa: Column | int, anchor_ms: Column | int) -> Column:
    """Time of a score, from a score whose time is known."""
    a, m = (F.lit(x) if isinstance(x, int) else x for x in (anchor_daa, anchor_ms))
    return m - (a - daa) * MS_PER_DAA


def image_kind(data: Column) -> Column:
    """Format of an image by its first bytes; null for any other."""
    h = F.hex(F.substring(data, 1, 12))
    riff = (F.length(data) > 12) & h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250")
    return F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("474946383761") | h.startswith("474946383961"), "gif").when(riff, "webp")


def balance_class(balance: Column, floor: int) -> Column:
    b = F.coalesce(balance, F.lit(0))
    return F.when(b <= 0, "zero").when(b < floor, "dust").otherwise("above")


def backoff(fails: Column, base: int, most: int) -> Column:
    """Wait after failures in a row: doubling from the first on, up to a bound."""
    power = F.greatest(F.lit(0), F.least(fails, F.lit(5)) - 1)
    return F.least((F.lit(base) * F.pow(F.lit(2), power)).cast("long"), F.lit(most).cast("long"))
