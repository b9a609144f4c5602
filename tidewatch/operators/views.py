"""Dashboard datasets built from the stored tables.

Every view is a plain DataFrame; presentation (HTML, colours, charts, PDF) is not built. Views that
start from a bounded read (newest 500 / 1000 rows) keep that order of steps: limit first, filters
after, exactly like the dashboard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..sources import tables as T
from . import reads as R
from .scoring import latest_by_id

# Matrix icons per rating; absent cells show an em dash, unknown ratings a question mark.
RATING_ICONS = {"green": "✓", "yellow": "≈", "red": "✗"}
ABSENT_ICON = "—"


def kpi_strip(roster: DataFrame, scores: DataFrame) -> DataFrame:
    """G1: per roster entity the latest score, its band and the trend against the previous score."""
    lp = R.latest_and_previous(scores.select("entity", "id", "threat_score"), "threat_score")
    j = roster.select("pos", "entity").join(lp, "entity", "left")
    d = F.col("latest") - F.col("previous")
    trend = (F.when(F.col("latest").isNull(), "no data").when(F.col("previous").isNull(), "first scan")
             .when(d > K.TREND_EPSILON, "up").when(d < -K.TREND_EPSILON, "down").otherwise("stable"))
    label = (F.when(F.col("previous").isNull(), F.lit(None).cast("string"))
             .when(d > K.TREND_EPSILON, F.concat(F.lit("+"), S.fmt1(d)))
             .when(d < -K.TREND_EPSILON, S.fmt1(d)).otherwise(F.lit(None).cast("string")))
    return j.select("pos", "entity", F.col("latest").alias("score"), S.score_band("latest").alias("band"),
                    trend.alias("trend"), label.alias("delta_label"))


def changes_view(changes: DataFrame, as_of: Column, entity=None, change_type=None, segment=None,
                 dedupe=None) -> DataFrame:
    """Newest 500 -> impact >= 2 -> last 90 days -> (C11 de-dup) -> segment filter."""
    top = R.changes(changes, K.CHANGES_VIEW_LIMIT, entity, change_type)
    kept = top.filter(F.col("customer_impact_score") >= K.IMPACT_GATE_MIN).filter(
        F.col("detected_at") >= as_of - F.make_interval(days=F.lit(K.CHANGES_VIEW_DAYS)))
    if dedupe is not None:
        kept = dedupe(kept)
    if segment is not None and segment != "All":
        kept = kept.filter(F.col("segment_affected") == segment)
    return kept


def news_window(news: DataFrame, as_of: Column, entity=None, impact_type=None) -> DataFrame:
    """G4 first half: newest-500 read, then 90 days or unparseable published date."""
    top = R.news(news, K.NEWS_VIEW_LIMIT, entity, impact_type)
    pub = S.lenient_timestamp(F.col("published_at"))
    return top.filter(pub.isNull() | (pub >= as_of - F.make_interval(days=F.lit(K.NEWS_VIEW_DAYS))))


def news_view(news: DataFrame, as_of: Column, entity=None, impact_type=None, level=None,
              dedupe=None) -> DataFrame:
    """Window -> per-entity story grouping (C6 + C7) -> level filter; sorted by relevance,
    fetched_at desc by the reader."""
    kept = news_window(news, as_of, entity, impact_type)
    if dedupe is not None:
        kept = dedupe(kept)
    if level is not None and level != "All":
        kept = kept.filter(S.relevance_level("relevance") == level)
    return kept


def reviews_view(roster: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Latest review analysis per roster entity, with the message for missing data."""
    latest = latest_by_id(sentiment.select("entity", "id", "sentiment", "severity_score", "themes",
                                           "top_complaints", "top_praise"))
    j = roster.select("pos", "entity", "app_id").join(latest, "entity", "left")
    msg = (F.when(F.col("id").isNull() & F.col("app_id").isNull(), "No app available for this entity.")
           .when(F.col("id").isNull(), "No review data yet.")
           .otherwise(F.lit(None).cast("string")))
    return j.select(
        "pos", "entity", "app_id", "sentiment", "severity_score",
        F.when(F.col("id").isNull(), F.lit(None).cast("string")).otherwise(S.severity_band("severity_score")).alias("severity_band"),
        F.array_join(F.coalesce("themes", F.array()), ", ").alias("themes"),
        F.size(F.coalesce("top_complaints", F.array())).cast("long").alias("n_complaints"),
        F.size(F.coalesce("top_praise", F.array())).cast("long").alias("n_praise"),
        msg.alias("message"),
    )


def comparison_cells(facts: DataFrame) -> DataFrame:
    """One rating per (entity, dimension); a repeated key keeps the last (largest id) value."""
    return facts.groupBy("entity", "dimension").agg(
        F.max_by(F.struct("rating", "note"), F.col("id")).alias("cell")).select(
        "entity", "dimension", "cell.rating", "cell.note")


def comparison_matrix(spark: SparkSession, cells: DataFrame, entities: list[str]) -> DataFrame:
    """Dimension rows x entity columns of rating icons; absent cells '—'.

    The pivot values are the fixed roster, so no extra job computes them; rows are the fixed
    dimension list so dimensions without any rating still appear.
    """
    icon = F.coalesce(
        *[F.when(F.col("rating") == r, F.lit(i)) for r, i in RATING_ICONS.items()], F.lit("?"))
    piv = cells.select("dimension", "entity", icon.alias("icon")).groupBy("dimension").pivot(
        "entity", entities).agg(F.first("icon"))
    dims = T.literal_table(spark, [(i, d) for i, d in enumerate(K.COMPARISON_DIMENSIONS)], "dim_pos int, dimension string")
    out = dims.join(piv, "dimension", "left")
    return out.select("dim_pos", "dimension", *[F.coalesce(F.col(e), F.lit(ABSENT_ICON)).alias(e) for e in entities])


def trend_latest(scores: DataFrame) -> DataFrame:
    """Newest point per entity by scanned_at; ties go to the first row (smallest id)."""
    ranked = R.ranked_per_entity(scores, 1, [F.col("scanned_at").desc(), F.col("id").asc()])
    return ranked.drop("rank")


def score_table(roster: DataFrame, scores: DataFrame) -> DataFrame:
    """Latest score row per entity in roster order; social/offers default 5.0/3.0."""
    latest = latest_by_id(scores)
    j = roster.select("pos", "entity").join(latest, "entity", "inner")
    return j.select(
        "pos", "entity", "threat_score", "review_component", "news_component", "feature_velocity_component",
        "smb_relevance_component",
        F.coalesce("social_component", F.lit(K.SOCIAL_BASELINE)).alias("social_component"),
        F.coalesce("offers_component", F.lit(K.OFFERS_BASELINE)).alias("offers_component"),
        "reason", S.date_prefix(S.iso_seconds(F.col("scanned_at"))).alias("date"),
    )


def product_view(products: DataFrame, entity=None, home_product=None) -> DataFrame:
    """Newest 1000 product rows, then the two filters."""
    top = R.product_rows(products, K.PRODUCT_VIEW_LIMIT)
    return R._eq(R._eq(top, "entity", entity), "home_product", home_product)


def product_entities(products: DataFrame) -> DataFrame:
    """G9 option list: distinct entities of the newest 1000 rows, sorted."""
    return R.product_rows(products, K.PRODUCT_VIEW_LIMIT).select("entity").distinct().orderBy("entity")


def product_gaps(products: DataFrame, entity=None) -> DataFrame:
    """Rows labelled as a gap; honours the entity filter, ignores the product filter."""
    top = R.product_rows(products, K.PRODUCT_VIEW_LIMIT)
    return R._eq(top, "entity", entity).filter(F.col("home_product") == K.GAP_LABEL)


def social_cards(roster: DataFrame, social: DataFrame) -> DataFrame:
    """Latest social row per entity with its videos exploded (entities without videos keep one row)."""
    latest = latest_by_id(social)
    j = roster.select("pos", "entity").join(latest, "entity", "inner")
    return j.select(
        "pos", "entity", "id", "campaign_focus", "tone_shift",
        F.array_join("target_segment_signals", ", ").alias("segments"), "mention_count",
        F.inline_outer("videos"),
    ).select("pos", "entity", "id", "campaign_focus", "tone_shift", "segments", "mention_count",
             "video_id", F.col("title").alias("video_title"),
             S.display_date(F.col("published_at")).alias("video_date"))


def offers_view(offers: DataFrame, entity=None, offer_type=None, segment=None) -> DataFrame:
    """Newest 1000 offers, then three equality filters."""
    top = R.offers(offers, K.OFFERS_VIEW_LIMIT)
    return R._eq(R._eq(R._eq(top, "entity", entity), "offer_type", offer_type), "target_segment", segment)


def offer_gaps(offers: DataFrame, entity=None) -> DataFrame:
    """Offers the home side does not (fully) match; entity filter only."""
    top = R.offers(offers, K.OFFERS_VIEW_LIMIT)
    return R._eq(top, "entity", entity).filter(F.col("home_match").isin("No", "Partial"))


def video_dates(df: DataFrame, col: str = "published_at") -> DataFrame:
    """Display date of a raw date text."""
    return df.withColumn("display_date", S.display_date(F.col(col)))


def fold_ascii(df: DataFrame, col: str) -> DataFrame:
    """Export-safe text."""
    return df.withColumn(col, S.fold_ascii(F.col(col)))


def rank_window(partition: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*partition).orderBy(*order)
