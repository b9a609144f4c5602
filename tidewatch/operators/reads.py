"""Read queries over the stored tables.

Filtered top-N reads are `filter -> orderBy -> limit`, which Catalyst plans as a pushed-down scan
filter plus TakeOrderedAndProject (a per-partition top-N heap, then one merge of N rows per
partition). Per-key "latest" and "previous" are aggregates or group-limited windows, never a scan
per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import latest_by_id


def _eq(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter where None or 'All' means no filter."""
    if value is None or value == "All":
        return df
    return df.filter(F.col(column) == F.lit(value))


def snapshot(df: DataFrame, entity: str, page_key: str) -> DataFrame:
    """point lookup by (entity, page_key)."""
    return df.filter((F.col("entity") == entity) & (F.col("page_key") == page_key))


def changes(df: DataFrame, limit: int = 100, entity=None, change_type=None) -> DataFrame:
    """newest changes (detected_at desc, id desc) after optional equality filters."""
    out = _eq(_eq(df, "entity", entity), "change_type", change_type)
    return out.orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(limit)


def product_rows(df: DataFrame, limit: int = 500, entity=None, home_product=None) -> DataFrame:
    """newest product mappings by analyzed_at; id desc breaks ties (unspecified upstream)."""
    out = _eq(_eq(df, "entity", entity), "home_product", home_product)
    return out.orderBy(F.col("analyzed_at").desc(), F.col("id").desc()).limit(limit)


def offers(df: DataFrame, limit: int = 500, entity=None, offer_type=None, segment=None) -> DataFrame:
    """newest offers by detected_at; id desc breaks ties."""
    out = _eq(_eq(_eq(df, "entity", entity), "offer_type", offer_type), "target_segment", segment)
    return out.orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(limit)


def news(df: DataFrame, limit: int = 100, entity=None, impact_type=None) -> DataFrame:
    """most relevant news, then newest fetched; id desc breaks ties."""
    out = _eq(_eq(df, "entity", entity), "impact_type", impact_type)
    return out.orderBy(F.col("relevance").desc(), F.col("fetched_at").desc(), F.col("id").desc()).limit(limit)


def latest_per_entity(df: DataFrame) -> DataFrame:
    """the max-id row per entity."""
    return latest_by_id(df)


def ranked_per_entity(df: DataFrame, n: int, order=None) -> DataFrame:
    """Rows ranked 1..n per entity (id desc by default); planned as a WindowGroupLimit."""
    order = order or [F.col("id").desc()]
    w = Window.partitionBy("entity").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def previous_per_entity(df: DataFrame) -> DataFrame:
    """the second-newest row per entity (entities with one row have none)."""
    return ranked_per_entity(df, 2).filter(F.col("rank") == 2).drop("rank")


def latest_and_previous(df: DataFrame, value: str) -> DataFrame:
    """Latest and previous `value` per entity side by side (previous NULL when < 2 rows)."""
    top2 = ranked_per_entity(df.select("entity", "id", value), 2)
    return top2.groupBy("entity").agg(
        F.max(F.when(F.col("rank") == 1, F.col(value))).alias("latest"),
        F.max(F.when(F.col("rank") == 2, F.col(value))).alias("previous"),
        F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("latest_id"),
    )


def score_history(df: DataFrame, entity=None) -> DataFrame:
    """F8: score history in (scanned_at, id) order."""
    return _eq(df, "entity", entity).orderBy("scanned_at", "id")


def latest_row(df: DataFrame) -> DataFrame:
    """the single newest row by id."""
    return df.orderBy(F.col("id").desc()).limit(1)


def events(df: DataFrame, entity=None) -> DataFrame:
    """events by date; id breaks ties."""
    return _eq(df, "entity", entity).orderBy("event_date", "id")


def event_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_events"))
