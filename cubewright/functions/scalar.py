"""Column expressions used all over the package."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest and largest value of integer pixel types.
INT_RANGE = {f"{s}int{b}": (0, 2**b - 1) if s else (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for s in ("u", "") for b in (8, 16, 32)} | {"bool": (0, 1)}
#: Abramowitz and Stegun 7.1.26, fixed values.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullif_nan(c: str | Column) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    return F.when(~F.isnan(col(c)), col(c))


def nullif_nonfinite(c: str | Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")), col(c))


def nan_aggregate(agg, c: str | Column) -> Column:
    """``agg`` without NaN; NaN if there was no finite value; null if there was nothing at all."""
    return F.when((F.count(col(c)) > 0) & (F.count(nullif_nonfinite(c)) == 0), F.lit(float("nan"))).otherwise(agg(nullif_nan(c)))


def round6(c: str | Column) -> Column:
    return F.round(col(c), 6)


def missing(c: str | Column, label: str = "(missing)") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(label))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def predicate(c: str, op: str | None, value: str | None, like: bool = False) -> Column:
    """A user's filter. ``like=True`` keeps ``%`` and ``_`` as wildcards; an empty value or unknown operator filters nothing.

    Comparisons take the number that the value begins with (``5px`` is 5); without one nothing matches.
    """
    text, number = col(c).cast("string"), col(c).try_cast("double")
    if value is None or value == "" or op not in ("contains", "not_contains", "eq", "gt", "ge", "lt", "le", "in"):
        return F.lit(True)
    inside = text.like(f"%{value}%") if like else F.contains(text, F.lit(value))
    if op in ("gt", "ge", "lt", "le"):
        m = re.match(r"\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", value)
        if not m:
            return F.lit(False)
        v = float(m[1])
        return {"gt": number > v, "ge": number >= v, "lt": number < v, "le": number <= v}[op]
    return {"contains": inside, "not_contains": ~inside, "eq": text == value, "in": text.isin([x.strip() for x in value.split(",")])}[op]


def search(columns: list[str], needle: str) -> Column:
    """Rows in which any of the columns holds ``needle``, whatever its case; wildcards in it are literal."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return any_of(col(c).cast("string").ilike(f"%{escaped}%") for c in columns)


def dim_subset(dims: list[str], fixed: dict[str, int] | None = None, split: Iterable[str] = (), use_level: bool = True) -> Column:
    """Rows of a cube with the ``fixed`` coordinates, one for each value of the ``split`` dimensions."""
    fixed, split = fixed or {}, list(split)
    level = [F.col("obs_level") == len(fixed) + len(split)] if use_level else []
    rest = [F.col(d).isNull() for d in dims if d not in fixed and d not in split]
    return all_of(level + [F.col(d) == i for d, i in fixed.items()] + [F.col(d).isNotNull() for d in split] + rest)


def normal_two_sided(z: Column) -> Column:
    """p of a two-sided normal test, by the polynomial for erf."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + ERF_P * x)
    poly = reduce(lambda a, c: (a + c) * t, reversed(ERF[:-1]), F.lit(ERF[-1]) * t)
    return poly * F.exp(-x * x)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def dtype_kind(c: str | Column) -> Column:
    """uint, int, float, or null for types without a numeric range."""
    return F.when(col(c).startswith("uint"), "uint").when(col(c).startswith("int"), "int").when(col(c).startswith("float"), "float")


def dtype_scale(c: str | Column) -> Column:
    """What bounds are divided by for a dtype-relative axis: 2^bits (uint), 2^(bits-1) (int), 1 (float)."""
    bits = F.regexp_extract(col(c), "([0-9]+)$", 1).try_cast("int")
    return F.when(dtype_kind(c) == "uint", F.pow(F.lit(2.0), bits)).when(dtype_kind(c) == "int", F.pow(F.lit(2.0), bits - 1)).otherwise(1.0)


def extension(name: str | Column, ext: str | Column | None = None) -> Column:
    """Lower-case extension, from the name where none is given; null for names without one."""
    given = F.nullif(F.lower(col(ext)), F.lit("")) if ext is not None else F.lit(None).cast("string")
    return F.coalesce(given, F.nullif(F.lower(F.regexp_extract(col(name), r"\.([^./]+)$", 1)), F.lit("")))


def ancestors(path: str | Column, include_self: bool = True) -> Column:
    """All prefixes of a path that end at a separator, shortest first."""
    parts = F.split(col(path), "/")
    n = F.size(parts) if include_self else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def title_case(c: str | Column) -> Column:
    """``size_bytes`` as ``Size Bytes``."""
    return F.initcap(F.regexp_replace(col(c), "_+", " "))


def byte_text(c: str | Column, largest: str = "PB") -> Column:
    """A number of bytes as text with the largest unit, up to ``largest``, that keeps it at 1 or more, one decimal beyond bytes."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    n = col(c).cast("double")
    out = F.concat(F.format_string("%.0f", n), F.lit(" B"))
    for k, unit in enumerate(units[1 : units.index(largest) + 1], 1):
        out = F.when(n >= 1024.0**k, F.concat(F.format_string("%.1f", n / 1024.0**k), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNotNull(), out)


def base_of(path: str | Column, bases: list[str]) -> Column:
    """The base folder that a path lies in, the deepest of several; null outside all."""
    return F.array_max(F.filter(F.array(*map(F.lit, bases)), lambda b: col(path).startswith(F.concat(b, F.lit("/")))))
