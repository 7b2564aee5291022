"""Column expressions: finiteness, rounding, classes, labels and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True for a number that is not null, NaN or infinite; never null."""
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def round_half_up(c: str | Column, decimals: int | str | Column) -> Column:
    """Half goes towards +infinity (-2.5 -> -2), unlike SQL's round()."""
    scale = F.pow(F.lit(10.0), F.lit(decimals) if isinstance(decimals, int) else _col(decimals))
    return F.floor(_col(c) * scale + 0.5) / scale


def year_label(code: str | Column, labels: str | Column) -> Column:
    """The label of a year code in a map, else the code itself."""
    code = _col(code)
    return F.coalesce(F.try_element_at(_col(labels), code), code)


def numeric_year(label: str | Column) -> Column:
    """The year as an integer, null if the label is no number."""
    return _col(label).try_cast("int")


def format_value(v: str | Column, decimals: int | Column, unit: str | Column | None = None) -> Column:
    """1234.5 -> '1.234,5 unit'; a dash for what is missing."""
    v = _col(v)
    decimals = F.lit(decimals) if isinstance(decimals, int) else decimals
    rounded = round_half_up(v, decimals)
    whole = F.format_number(F.floor(F.abs(rounded)), 0)
    # the decimals, padded; format_number wants a literal number of them
    part = F.rpad(F.split(F.format_number(F.abs(rounded) - F.floor(F.abs(rounded)), 17), "[.]")[1], 17, "0")
    scaled = F.lpad(F.floor((F.abs(rounded) - F.floor(F.abs(rounded))) * F.pow(F.lit(10.0), decimals) + 0.5).cast("long").cast("string"), 17, "0")
    few = F.coalesce(*[F.when(decimals == d, F.format_number(rounded, d)) for d in range(7)])
    many = F.concat(F.when(rounded < 0, "-").otherwise(""), whole, F.lit("."), F.when(decimals > 15, F.substring(part, 1, 17)).otherwise(F.substring(scaled, 18 - decimals, decimals)))
    text = F.translate(F.coalesce(few, many), ",.", ".,")
    if unit is not None:
        unit = _col(unit)
        text = F.concat_ws(" ", text, F.when(unit != "", unit))
    return F.when(finite(v), text).otherwise("—")


def format_compact(v: str | Column, decimals: int = 0) -> Column:
    """Millions as 'x.x M', from ten thousand 'n k', else the decimals asked for."""
    v = _col(v)
    millions = F.concat(F.format_number(round_half_up(v / 1e6, 1), 1), F.lit(" M"))
    thousands = F.concat(round_half_up(v / 1e3, 0).cast("long").cast("string"), F.lit(" k"))
    return F.when(~finite(v), "—").when(F.abs(v) >= 1e6, F.regexp_replace(millions, ",", "")).when(F.abs(v) >= 1e4, thousands).otherwise(format_value(v, decimals))


def sequential_class(v: str | Column, cuts: str | Column) -> Column:
    """How many cuts lie below the value; null if it is missing."""
    v = _col(v)
    return F.when(finite(v), F.size(F.filter(_col(cuts), lambda c: v > c)))


def diverging_class(v: str | Column, step: str | Column, middle: float = 100.0) -> Column:
    """-3..3 about the middle; within half a step of it, 0."""
    offset = F.try_divide(_col(v) - middle, _col(step))
    ranks = F.least(F.lit(3), F.ceil(F.abs(offset))).cast("int")
    return F.when(finite(v), F.when(F.abs(offset) < 0.5, 0).otherwise((F.signum(offset) * ranks).cast("int")))


def class_for(kind: str | Column, v: str | Column, cuts: str | Column, step: str | Column) -> Column:
    return F.when(_col(kind) == "index", diverging_class(v, step)).otherwise(sequential_class(v, cuts))


def mercator(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    return F.radians(_col(lon)), F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_col(lat)) / 2))


def laea(lon: str | Column, lat: str | Column, lon0: float | Column = 15.0, lat0: float | Column = 54.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area projection (Snyder 1987), unit sphere."""
    lon0, lat0 = (x if isinstance(x, Column) else F.lit(x) for x in (lon0, lat0))
    lam, phi = F.radians(_col(lon) - lon0), F.radians(_col(lat))
    s0, c0 = F.sin(F.radians(lat0)), F.cos(F.radians(lat0))
    k = F.sqrt(F.try_divide(F.lit(2.0), 1 + s0 * F.sin(phi) + c0 * F.cos(phi) * F.cos(lam)))
    return k * F.cos(phi) * F.sin(lam), k * (c0 * F.sin(phi) - s0 * F.cos(phi) * F.cos(lam))


def route_inset(insets: str | Column, region_id: str | Column, lon: str | Column) -> Column:
    """The sub-projection that a feature is drawn in, by the rules of its geography: `west` by
    its least longitude, `islands` by its id; any other geography has none."""
    insets, prefix = _col(insets), F.substring(_col(region_id), 1, 2)
    return (
        F.when((insets == "west") & (_col(lon) <= -10), "canaries")
        .when((insets == "islands") & (prefix == "IS"), "iceland")
        .when((insets == "islands") & prefix.isin("CY", "MT"), "east")
        .otherwise("main")
    )


def ring_area(xs: str | Column, ys: str | Column) -> Column:
    """Shoelace area of a ring given by its vertices, closed or not."""
    xs, ys = _col(xs), _col(ys)
    n = F.size(xs)
    terms = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i),
    )
    return F.when(n > 2, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2).otherwise(0.0)


def array_mean(xs: str | Column) -> Column:
    xs = _col(xs)
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))
