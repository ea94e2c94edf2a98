"""Bucketed and sorted tables, for joins and distincts without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from basketlens.operators.quality import observed
from basketlens.sinks.files import folder_bytes, remove_folder
from basketlens.sinks.layout import buckets_for


class HotKeySplit(NamedTuple):
    """Names of the two tables of a bucketed fact table."""

    bucketed: str
    hot: str


class Kept(NamedTuple):
    """Rows written once, to be measured and read again."""

    rows: DataFrame
    folder: str
    size: int


def _keep(df: DataFrame, path: str | None) -> Kept:
    """Write ``df`` beside ``path`` (without one, in the warehouse folder, which executors share, too)."""
    spark = df.sparkSession
    root = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/rows"
    folder = f"{root}_kept_{uuid4().hex}"
    df.write.format("orc").option("compression", "snappy").save(folder)
    return Kept(spark.read.schema(df.schema).orc(folder), folder, folder_bytes(spark, folder))


def write_bucketed(
    df: DataFrame,
    table: str,
    keys: Sequence[str],
    buckets: int | None = None,
    path: str | None = None,
) -> int:
    """Replace ``table`` by ``df``, bucketed and sorted on ``keys``; the number of buckets.

    Without ``buckets`` the rows are written once to measure their bytes. Rows are brought together by bucket
    number, so that the number of files does not grow with tasks times buckets; adaptive execution splits a bucket
    that is too large for one writer over several files.
    """
    if buckets is None:
        kept = _keep(df, path)
        buckets = write_bucketed(kept.rows, table, keys, buckets_for(kept.size), path)
        remove_folder(df.sparkSession, kept.folder)
        return buckets
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))
    columns = df.columns
    placed = df.withColumn("_bucket", bucket).hint("rebalance", "_bucket").select(*columns)
    writer = (
        placed.write.mode("overwrite")
        .format("orc")
        .option("compression", "snappy")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return buckets


def hot_candidates(key: str, share: float) -> list:
    """Aggregates for ``DataFrame.observe`` that find every key with more than ``share`` of the rows.

    A sketch of frequent items holds so many counters that none of these keys, fewer than ``1 / share``, can
    miss its list; it may list others.
    """
    few = math.ceil(1 / share)
    sketch = F.expr(f"approx_top_k(`{key}`, {2 * few}, {max(1000, 40 * few)})")
    return [F.count(F.lit(1)).alias("rows"), sketch.alias("top")]


def _hot_keys(kept: Kept, key: str, share: float, seen: Observation) -> list:
    """The keys with more than ``share`` of the rows: the sketch's candidates, counted exactly."""
    found = observed(seen)
    listed = [r["item"] for r in found.get("top") or [] if r["item"] is not None]
    counts = kept.rows.where(F.col(key).isin(listed)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") > share * found.get("rows", 0)).collect()] if listed else []


def write_bucketed_facts(
    facts: DataFrame,
    tables: HotKeySplit,
    key: str,
    buckets: int | None = None,
    hot_share: float = 0.02,
    paths: HotKeySplit | None = None,
) -> int:
    """Write ``facts`` bucketed on ``key``, the rows of its frequent keys apart; the number of buckets.

    A bucket is read by one task, so a key with more than ``hot_share`` of the rows must not be in one, nor rows
    without key. The facts are computed once: they are written as they are, and while that is done a sketch of the frequent
    keys goes along. Its few candidates are counted exactly in what was written, and both tables are made
    from there. Without ``buckets`` their number follows from the bytes written.
    """
    spark = facts.sparkSession
    seen = Observation()
    kept = _keep(facts.observe(seen, *hot_candidates(key, hot_share)), paths and paths.bucketed)
    is_hot = F.col(key).isNull() | F.col(key).isin(_hot_keys(kept, key, hot_share, seen))
    buckets = buckets or buckets_for(kept.size)
    write_bucketed(kept.rows.where(~is_hot), tables.bucketed, [key], buckets, paths and paths.bucketed)
    hot = kept.rows.where(is_hot).write.mode("overwrite").format("orc")
    if paths is not None:
        hot = hot.option("path", paths.hot)
    hot.option("compression", "snappy").saveAsTable(tables.hot)
    remove_folder(spark, kept.folder)
    return buckets
