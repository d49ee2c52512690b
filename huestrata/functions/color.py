"""Colours as column expressions, with no Python function in the row path.

Components are numbers in 0..1 and hue is in degrees. A missing or
out-of-range component gives NULL. The hue sextants follow the published HSV
model and the transfer curve is the one of the sRGB standard.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.functions.nulls import _col


def _component(c: Column | str | int | float) -> Column:
    if isinstance(c, (int, float)):
        return F.lit(float(c))
    return _col(c).cast("double")


def _packed(red: Column, green: Column, blue: Column) -> Column:
    def byte(c: Column) -> Column:
        return F.floor(c * 255 + 0.5)

    return byte(red) * 65536 + byte(green) * 256 + byte(blue)


def _hex(packed: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(packed), 6, "0"))


def with_hsv_hex(
    df: DataFrame,
    hue: Column | str,
    colours: Mapping[str, tuple[Column | str | float, Column | str | float]],
) -> DataFrame:
    """Add ``#RRGGBB`` columns for one hue and named (saturation, value) pairs.

    A channel is ``value * (1 - saturation * depth)``, where its depth (0 at the
    top, 1 at the bottom) comes from the hue alone. The hue steps are columns of
    their own, shared by all pairs, which keeps the generated methods small
    enough for the JVM to compile.
    """
    turn, sextant, slope = F.col("_turn"), F.col("_sextant"), F.col("_slope")
    part = turn - sextant

    def depth(top: tuple[int, int], middle: tuple[int, int]) -> Column:
        return F.when(sextant.isin(*top), 0.0).when(sextant.isin(*middle), slope).otherwise(1.0)

    def colour(saturation: Column | str | float, value: Column | str | float) -> Column:
        s, v = _component(saturation), _component(value)
        channels = [v * (1 - s * F.col(c)) for c in ("_red", "_green", "_blue")]
        known = slope.isNotNull() & s.between(0, 1) & v.between(0, 1)
        return F.when(known, _hex(_packed(*channels)))

    return (
        df.withColumn("_turn", F.pmod(_component(hue), F.lit(360.0)) / 60)
        .withColumn("_sextant", F.floor(turn).cast("int"))
        .withColumn("_slope", F.when(sextant % 2 == 0, 1 - part).otherwise(part))
        .withColumns(
            {
                "_red": depth((0, 5), (1, 4)),
                "_green": depth((1, 2), (0, 3)),
                "_blue": depth((3, 4), (2, 5)),
            }
        )
        .withColumns({name: colour(*pair) for name, pair in colours.items()})
        .drop("_turn", "_sextant", "_slope", "_red", "_green", "_blue")
    )


def rgb_to_hex(red: Column | str, green: Column | str, blue: Column | str) -> Column:
    """``#RRGGBB`` of linear red, green and blue."""

    def encode(c: Column) -> Column:
        return F.when(c <= 0.0031308, c * 12.92).otherwise(
            F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055
        )

    linear = [_component(c) for c in (red, green, blue)]
    known = linear[0].between(0, 1) & linear[1].between(0, 1) & linear[2].between(0, 1)
    return F.when(known, _hex(_packed(*[encode(c) for c in linear])))
