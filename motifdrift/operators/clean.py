"""Cleaning and de-duplication of isolate records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifdrift import settings
from motifdrift.functions.columns import DAY_POLICIES, PERIODS, parsed_date


def drop_ambiguous(df: DataFrame, letters: str = settings.AMBIGUOUS) -> DataFrame:
    return df.filter(~F.col("sequence").rlike("[" + re.escape(letters) + "]"))


def require_terminator(df: DataFrame, mark: str = settings.TERMINATOR) -> DataFrame:
    return df.filter(F.col("sequence").endswith(mark))


def require_length(df: DataFrame, low: int = settings.LENGTH_BOUNDS[0], high: int = settings.LENGTH_BOUNDS[1]) -> DataFrame:
    return df.filter(F.length("sequence").between(low, high))


def split_description(df: DataFrame) -> DataFrame:
    """isolate_name and timestamp are parts 2 and 3 of at most four parts between |."""
    parts = F.split("description", r"\|", 4)
    return df.withColumn("isolate_name", F.get(parts, F.lit(1))).withColumn("timestamp", F.get(parts, F.lit(2))).drop("description")


def apply_day_policy(df: DataFrame, policy: str = "shift") -> DataFrame:
    return df.withColumn("timestamp", DAY_POLICIES[policy](F.col("timestamp")))


def parse_dates(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", parsed_date(F.col("timestamp")))


def drop_null_dates(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["timestamp"])


def value_key(value: str, digest: Callable[[Column], Column] = F.md5) -> Column:
    """What a long text or nested array is grouped by: its 128-bit digest, and a second hash and its length, by which equal digests are verified."""
    text = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
    return F.struct(F.unhex(digest(text)).alias("digest"), F.xxhash64(value).alias("proof"), F.length(text).alias("size"))


def first_of(df: DataFrame, keys: list[str], order: list[str], values: tuple[str, ...] = (), keep: list[str] | None = None, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """The first row of each key, by order. min_by combines on the map side, so a hot key is a row for each task, not a sorted group.

    values are keys too, but long: rows are exchanged and sorted by their value_key(), and a value travels once, in the row that is first; not at all where it
    isn't in keep (the columns of the result; all without it).
    """
    names = keep or df.columns
    hashed = {f"_key_{i}": value_key(v, digest) for i, v in enumerate(values)}
    others = [c for c in names if c not in keys]
    first = df.withColumns(hashed).groupBy(*keys, *hashed).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*names)


def dedupe_isolates_in_batch(df: DataFrame) -> DataFrame:
    return first_of(df, ["batch_no", "isolate_name"], ["record_idx"])


def dedupe_isolates_in_period(df: DataFrame) -> DataFrame:
    return first_of(df, ["period", "isolate_name"], ["batch_no", "timestamp", "record_idx"])


def dedupe_sequences_in_period(df: DataFrame) -> DataFrame:
    """Keyed by a digest of the sequence, verified: partial aggregates carry the sequence itself once for each task."""
    return first_of(df, ["period"], ["batch_no", "timestamp", "record_idx"], ("sequence",))


def sort_by_date(df: DataFrame) -> DataFrame:
    """Rows by date; of one day in order of batch and record. Rows without a date come last."""
    return df.orderBy(F.asc_nulls_last("timestamp"), *[c for c in ("batch_no", "record_idx") if c in df.columns])


def valid_sequences(df: DataFrame) -> DataFrame:
    return require_length(require_terminator(drop_ambiguous(df)))


def cleaned(df: DataFrame, batch_records: int = settings.BATCH_RECORDS, policy: str = "shift") -> DataFrame:
    """Valid, dated records: one for each isolate in a batch - chosen before dates are looked at - and rows without a date dropped."""
    batched = df.withColumn("batch_no", F.floor(F.col("record_idx") / batch_records).cast("int"))
    named = apply_day_policy(split_description(valid_sequences(batched)), policy)
    return drop_null_dates(parse_dates(dedupe_isolates_in_batch(named)))


def with_period(df: DataFrame, technique: str = "month") -> DataFrame:
    """Adds period; rows of no period are dropped."""
    return df.withColumn("period", PERIODS[technique](F.col("timestamp"))).filter("period is not null")


def period_tables(df: DataFrame, technique: str = "month", batch_records: int = settings.BATCH_RECORDS) -> DataFrame:
    return dedupe_isolates_in_period(with_period(cleaned(df, batch_records), technique))


def period_row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("period").agg(F.count("*").alias("n"))


def count_distinct_periods(df: DataFrame) -> int:
    return df.select("period").distinct().count()


def year_span(df: DataFrame) -> DataFrame:
    return df.agg(F.min(F.year("timestamp")).alias("first_year"), F.max(F.year("timestamp")).alias("last_year"))


def period_index(df: DataFrame, key) -> DataFrame:
    """Adds period_idx: 0.. in natural order of the present periods. Only the distinct periods are ordered in one task."""
    order = Window.orderBy(key)
    return df.join(F.broadcast(df.select("period").distinct().withColumn("period_idx", (F.row_number().over(order) - 1).cast("int"))), "period")
