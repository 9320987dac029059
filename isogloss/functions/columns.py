"""Scalar functions as column expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """x rounded to digits as binary doubles round: scale, round to the even integer, scale back."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def not_a_number_to_null(x: Column) -> Column:
    """Null for NaN, which Spark would sort above every number."""
    return F.when(~F.isnan(x), x)


def natural_key(x: Column) -> list[Column]:
    """Sort keys that put layer-2 before layer-10: the text before the first digit, then the number (null without)."""
    return [F.regexp_extract(x, r"^(\D*)", 1), F.regexp_extract(x, r"(\d+)", 1).try_cast("int")]


def path_part(path: Column, from_end: int, separator: str = "/") -> Column:
    """The from_end-th part of a path, 1 being the last; null where there are fewer."""
    return F.try_element_at(F.split(path, f"[{separator}]"), F.lit(-from_end))


def file_stem(name: Column) -> Column:
    """The name up to its last dot, or all of it without one."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def without_ending(path: Column, ending: str) -> Column:
    """A path without the first place where any character stands before `ending`; all of it where there is none."""
    return F.regexp_replace(path, rf"(?s)^(.*?).\Q{ending}\E", "$1")


def partition_name(model: Column, layer: Column, method: Column) -> Column:
    """The name of a clustering's partition file; the one of transcription distances has no layer."""
    return F.concat_ws(".", F.when(model == "LD", model).otherwise(F.concat_ws("-", model, layer)), method, F.lit("initclust.n4"))


def zero_padded(x: Column, width: int) -> Column:
    """The number as text with zeros in front up to width; longer ones are kept."""
    text = x.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def ground_distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays of doubles of one length."""
    if metric == "circle":
        return F.pmod(a[0] - b[0], F.lit(1.0))
    each = F.zip_with(a, b, lambda x, y: F.abs(x - y) if metric == "cityblock" else (x - y) * (x - y))
    total = F.aggregate(each, F.lit(0.0), lambda s, v: s + v)
    if metric == "euclidean":
        return F.sqrt(total)
    if metric in ("sqeuclidean", "cityblock"):
        return total
    raise ValueError(f"unknown metric {metric!r}")


def contains(x: Column, part: str) -> Column:
    """Whether a text has a part; false for null."""
    return F.coalesce(F.contains(x, F.lit(part)), F.lit(False))
