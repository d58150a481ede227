"""Keyed tables on immutable data: look-ups, last-writer-wins upserts, deletes.

Reads are joins; writes return the new state of the table, which
:mod:`quern.sources.snapshots` commits atomically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the one greatest by ``order``.

    An aggregate with partial states, so repeated keys are reduced before they
    are shuffled, however often one occurs.
    """
    others = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "_row.*").select(*df.columns)


def get_by_ids(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the store whose key is among ``ids``; repeated ids give one row, misses none."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def filter_missing(ids: DataFrame, store: DataFrame, key: str, distinct: bool = True) -> DataFrame:
    """Ids that the store does not have."""
    wanted = ids.select(key).filter(F.col(key).isNotNull())
    return (wanted.distinct() if distinct else wanted).join(store.select(key), key, "left_anti")


def upsert(store: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The store with the latest new row of each key in place of the old one."""
    fresh = latest(new, key, *order) if order else new.dropDuplicates([key])
    return fresh.unionByName(store.join(fresh.select(key), key, "left_anti"))


def delete(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The store without the given keys; unknown ones are ignored."""
    return store.join(ids.select(key), key, "left_anti")


def fetch_ordered(lists: DataFrame, key: str, ids: str, store: DataFrame, store_key: str, content: str, keep_missing: bool = False) -> DataFrame:
    """``key, pos, id, content`` for every id of every list, in list order.

    Missing ids and blank contents are dropped, or kept with an empty content.
    """
    wanted = lists.select(key, F.posexplode(ids).alias("pos", "id"))
    found = store.select(F.col(store_key).alias("id"), F.col(content).alias("content"))
    if keep_missing:
        return wanted.join(found, "id", "left").select(key, "pos", "id", F.coalesce("content", F.lit("")).alias("content"))
    return wanted.join(found.filter(F.trim("content") != ""), "id").select(key, "pos", "id", "content")
