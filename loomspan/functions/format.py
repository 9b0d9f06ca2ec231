"""Numbers and durations in a width of six characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_percent(share) -> Column:
    """A share from 0 to 1 as six characters of percent."""
    p = _c(share) * 100
    return F.when(p >= 99.995, F.format_string("%5.1f%%", p)).when(p >= 9.9995, F.format_string("%5.2f%%", p)).otherwise(F.format_string("%5.3f%%", p))


def format_integer(n) -> Column:
    return F.format_string("%6d", _c(n).cast("long"))


def format_number(x) -> Column:
    """Six characters: plain digits for sizes between a thousandth and a thousand, else mantissa and exponent."""
    v = _c(x).cast("double")
    size = F.abs(v)
    digits = F.ceil(F.log10(size))
    whole = F.log10(size) == digits
    step = F.when(whole & (digits >= 0), F.least(digits, F.lit(1))).otherwise(0)
    up = 5 - F.greatest(F.lit(1), digits) - step
    up = up - F.when(~whole & (digits > 0) & (v >= F.pow(F.lit(10.0), digits) - 5 * F.pow(F.lit(10.0), digits - 6)), 1).otherwise(0)
    down = 4 - F.greatest(F.lit(1), digits) - step
    down = down - F.when(~whole & (digits > 0) & (v <= -F.pow(F.lit(10.0), digits) + 5 * F.pow(F.lit(10.0), digits - 5)), 1).otherwise(0)
    plain = F.when(v == 0, F.format_string("%6.4f", v)).otherwise(F.lpad(_fixed(v, F.greatest(F.when(v > 0, up).otherwise(down), F.lit(0))), 6, " "))
    exponent = F.floor(F.log10(size))
    mantissa = size * F.pow(F.lit(10.0), -exponent)
    short = F.abs(exponent) < 10
    head = F.when((v > 0) & short, F.format_string("%.1f", F.least(mantissa, F.lit(9.9)))).otherwise(F.format_string("%.0f", F.least(mantissa, F.lit(9.0))))
    far = (v > 0) & (F.abs(exponent) >= 10) & (F.abs(exponent) < 100)
    bounded = F.least(F.greatest(exponent, F.lit(-99)), F.lit(99))
    power = F.when(v > 0, F.format_string("%d", exponent)).when(exponent > 0, F.format_string("%02d", bounded)).otherwise(F.format_string("%03d", bounded))
    scientific = F.concat(F.when(v < 0, "-").when(far, "+").otherwise(""), head, F.when(exponent > 0, "e+").otherwise("e"), power)
    return F.when((v != 0) & ((size >= 1e3) | (size <= 1e-3)), scientific).otherwise(plain)


def _fixed(value: Column, places: Column) -> Column:
    out = F.format_string("%.0f", value)
    for n in range(1, 6):
        out = F.when(places == n, F.format_string(f"%.{n}f", value)).otherwise(out)
    return out


def format_time(seconds) -> Column:
    """s, m:s, h:m:s or d h:m:s, the first number padded to a width of six."""
    s = _c(seconds).cast("long")
    ss, mm, hh, d = s % 60, F.floor(s / 60) % 60, F.floor(s / 3600) % 24, F.floor(s / 86400)
    minutes = F.floor(s / 60)
    return F.when(minutes == 0, F.format_string("%5ds", ss)).when(s < 3600, F.format_string("%3d:%02d", mm, ss)).when(d == 0, F.format_string("%1d:%02d:%02d", hh, mm, ss)).otherwise(F.format_string("%1d %02d:%02d:%02d", d, hh, mm, ss))
