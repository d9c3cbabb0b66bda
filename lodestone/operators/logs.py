"""Logs and states: upserts by key, the latest state of each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stages in order.
STAGES = ("literature_search", "title_abstract_screening", "pdf_download", "fulltext_screening", "reaction_data_extraction")


def upsert(existing: DataFrame, new: DataFrame, key: str = "row") -> DataFrame:
    """Rows of existing whose key is not among new, and all of new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_sorted(existing: DataFrame, new: DataFrame, key: str = "row") -> DataFrame:
    """upsert() in the order of the key, as a log is kept."""
    return upsert(existing, new, key).orderBy(key)


def run_id(name: Column, when: Column) -> Column:
    """A run's name from that of its configuration and the time (UTC in the session's zone): no spaces, no path separators."""
    return F.concat_ws("_", F.translate(name, " /\\", "___"), F.date_format(when, "yyyyMMdd_HHmmss"))


def latest(events: DataFrame, by: list[str], seq: str, value: str) -> DataFrame:
    """The value with the highest seq for each key."""
    return events.groupBy(*by).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def summary(states: DataFrame, runs: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """run_id, place, stage, status of all stages in order; 'pending' where nothing is known."""
    order = F.posexplode(F.array(*map(F.lit, stages))).alias("place", "stage")
    return runs.select("run_id", order).join(states, ["run_id", "stage"], "left").select("run_id", "place", "stage", F.coalesce("status", F.lit("pending")).alias("status"))
