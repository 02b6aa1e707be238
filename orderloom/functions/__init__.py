"""Column functions that reports and sources share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_zipcode(text: Column) -> Column:
    """Five digits and nothing else."""
    return text.rlike(r"^[0-9]{5}$")


def iso_time(text: Column) -> Column:
    """ISO 8601 with an offset or ``Z``; null where it isn't."""
    return F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00"))


def title_case(name: Column) -> Column:
    """``customer_segmentation`` as ``Customer Segmentation``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def encode_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def decode_json(text: Column, schema: str) -> Column:
    """Null for what isn't JSON of that schema."""
    return F.from_json(text, schema)


def recent_or_never(when: Column, as_of: str, days: int) -> Column:
    """No time at all, or one within ``days`` before ``as_of``."""
    return when.isNull() | (when >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"))


def shuffled(df: DataFrame, key: str, seed: int = 1, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the rows in an order by a hash of an integer key: random to look at, and the same at every run."""
    place = F.pmod((F.col(key) + seed) % (1 << 31) * 2654435761, F.lit(1 << 32))
    return df.orderBy(place, key).offset(offset).limit(limit)
