"""Deduplication that keeps the first row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .ranking import first_rows


def keep_first(df: DataFrame, keys: list[Column | str], ident: str) -> DataFrame:
    return first_rows(df, keys, [ident]).drop("rn")


def not_known(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key ``known`` does not have."""
    return df.join(known.select(*on).distinct(), on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """New rows take the place of old ones with their key."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)
