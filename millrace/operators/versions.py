"""Version history: latest, as of a version, rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookup import first_per_key


def latest_versions(history: DataFrame, key: str, version: str = "version") -> DataFrame:
    return first_per_key(history, [key], [F.desc(version)])


def version_as_of(history: DataFrame, key: str, at: int, version: str = "version") -> DataFrame:
    """The newest version of each key that is not newer than ``at``."""
    return latest_versions(history.where(F.col(version) <= at), key, version)


def rollback(history: DataFrame, key: str, key_value, to_version: int, version: str = "version"
             ) -> DataFrame:
    """The history plus a new version of one key that repeats the content of an older one."""
    mine = history.where(F.col(key) == key_value)
    newest = mine.agg(F.max(version).alias("top")).first()["top"]
    if newest is None:
        raise ValueError(f"no versions of {key_value!r}")
    following = F.lit(newest + 1).cast(history.schema[version].dataType)
    again = mine.where(F.col(version) == to_version).withColumn(version, following)
    return history.unionByName(again)
