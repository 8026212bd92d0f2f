"""Rounding, the colour scale and bands, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.schema import BANDS, SIGN_COLORS, STOPS_DARK


def rounded(c: Column, places: int) -> Column:
    """Half to even on the scaled binary value, as array libraries round; never negative zero."""
    scale = float(10**places)
    return F.rint(c * scale) / scale + F.lit(0.0)


def r2(c: Column) -> Column:
    return rounded(c, 2)


def round_frame(df: DataFrame, places: int = 2) -> DataFrame:
    """All double columns rounded, others untouched."""
    return df.select(*[rounded(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def nan_to_null(c: str) -> Column:
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def lookup(code: Column, names: Mapping[str, str]) -> Column:
    """The name of a code, else the code; the map is a literal, so no join is needed."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def score_channel(score: Column, channel: int, stops: list[tuple] = STOPS_DARK) -> Column:
    """Red (0), green (1) or blue (2) of a score: linear between stops, half up; null counts as 0."""
    s = clamp(F.coalesce(score, F.lit(0.0)))

    def piece(a: tuple, b: tuple) -> Column:
        at, step = float(a[channel + 1]), float(b[channel + 1] - a[channel + 1])
        return F.floor(F.lit(at) + (s - float(a[0])) / float(b[0] - a[0]) * step + 0.5)

    pairs = list(zip(stops, stops[1:], strict=False))
    arms = reduce(lambda w, p: w.when(s <= float(p[1][0]), piece(*p)), pairs[1:], F.when(s <= float(pairs[0][1][0]), piece(*pairs[0])))
    return arms.cast("int")


def score_rgb(score: Column, stops: list[tuple] = STOPS_DARK) -> Column:
    return F.format_string("rgb(%d,%d,%d)", *[score_channel(score, k, stops) for k in range(3)])


def score_band(score: Column) -> Column:
    """Null for a null score."""
    arms = F.when(score < BANDS[1][0], BANDS[0][1])
    for (_, name), (end, _) in zip(BANDS[1:], BANDS[2:], strict=False):
        arms = arms.when(score < end, name)
    return arms.when(score.isNotNull(), BANDS[-1][1])


def short_count(n: Column) -> Column:
    """12.3k from a thousand on."""
    return F.when(n >= 1000, F.format_string("%.1fk", n / 1000.0)).otherwise(n.cast("string"))


def thousands(n: Column, separator: str = ".") -> Column:
    """1.234.567"""
    return F.regexp_replace(F.format_number(n, 0), ",", separator)


def signed(x: Column, places: int = 1) -> Column:
    """+1.5, -0.3 and +0.0; half away from zero on the exact binary value."""
    return F.format_string(f"%+.{places}f", x + F.lit(0.0))


def sign_color(x: Column) -> Column:
    """One colour from 0 on, another below; null for null."""
    return F.when(x >= 0, SIGN_COLORS[0]).when(x < 0, SIGN_COLORS[1])


def rgba(color: Column, alpha: float) -> Column:
    """A colour #rrggbb or rgb(r,g,b) with an alpha."""
    h = F.regexp_replace(color, "^#", "")
    part = lambda k: F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10)
    named = F.regexp_extract(color, r"^rgb\((.*)\)$", 1)
    numbers = F.when(color.startswith("rgb("), named).otherwise(F.concat_ws(",", part(0), part(1), part(2)))
    return F.concat(F.lit("rgba("), numbers, F.lit(f",{alpha:g})"))
