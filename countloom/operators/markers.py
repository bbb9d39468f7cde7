"""Marker tables: (feature, label) pairs from wide or listed sources, brought under the labels of the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def plain_name(name: Column) -> Column:
    """Feature names as they are compared: upper case, without hyphens and outer blanks."""
    return F.upper(F.replace(F.trim(name), F.lit("-"), F.lit("")))


def from_flags(table: DataFrame, feature: str, labels: Iterable[str]) -> DataFrame:
    """(feature, label) of a wide table with a boolean (or 0/1) column for each label; nulls are no markers."""
    wide = table.select(plain_name(F.col(feature)).alias("feature"), *(F.col(c).cast("boolean").alias(c) for c in labels))
    return wide.unpivot("feature", list(labels), "label", "marks").where("marks and feature is not null").select("feature", "label").distinct()


def from_lists(table: DataFrame, feature: str, listed: str, pattern: str = r"\s*[;,|]\s*") -> DataFrame:
    """(feature, label) of a table that lists a feature's labels in one text; what follows a colon (a score) goes."""
    label = F.explode(F.split(F.col(listed), pattern)).alias("label")
    x = table.select(plain_name(F.col(feature)).alias("feature"), label).withColumn("label", F.trim(F.regexp_replace("label", r":.*$", "")))
    return x.where("label <> '' and feature is not null").distinct()


def combined(reference: DataFrame, others: Iterable[DataFrame] = (), *, how: str = "intersect") -> DataFrame:
    """Pairs of ``reference`` that every other source has too, or (``union``) that any has."""
    if how not in ("intersect", "union"):
        raise ValueError("how is intersect or union")
    join = (lambda a, b: a.join(b, ["feature", "label"], "left_semi")) if how == "intersect" else (lambda a, b: a.unionByName(b))
    return reduce(join, others, reference.select("feature", "label")).distinct()


def mapped(markers: DataFrame, names: Mapping[str, list[str]], *, exclusive: bool = False) -> DataFrame:
    """Markers under the data's labels: each of ``names`` stands for one or more labels of the source.

    A source's label that belongs to two names raises, as does an empty list. With ``exclusive`` only features of one name stay.
    """
    pairs = [(old, new) for new, olds in names.items() for old in olds]
    if not pairs or not all(names.values()):
        raise ValueError("every name needs a label")
    if len({old for old, _ in pairs}) < len(pairs):
        raise ValueError("a label belongs to two names")
    new = F.try_element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), F.col("label"))
    out = markers.select("feature", new.alias("label")).where("label is not null").distinct()
    if not exclusive:
        return out
    one = out.groupBy("feature").agg(F.count("*").alias("n"), F.first("label").alias("label"))
    return one.where("n = 1").select("feature", "label")


def flags(markers: DataFrame, labels: list[str]) -> DataFrame:
    """One row a feature, with a boolean column for each label."""
    wide = markers.groupBy("feature").pivot("label", labels).agg(F.lit(True))
    return wide.select("feature", *(F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(c) for c in labels))
