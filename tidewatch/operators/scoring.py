"""Signal components, composite score and the text summaries built on them.

Each component is a per-entity aggregate (partial aggregation on the map side, so the shuffle moves
one row per entity per partition) LEFT JOINed to the roster. The roster and every component are
bounded by the number of entities, so the joins between them are broadcast-sized by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S


def _lookup(mapping: dict, key: Column, default: float) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def news_component(news: DataFrame) -> DataFrame:
    """Mean relevance of the scan's fresh articles per entity (baseline applied at the join)."""
    return news.groupBy("entity").agg((F.sum("relevance") / F.count("relevance")).alias("news_value"))


def static_component(entities: DataFrame, weights: DataFrame) -> DataFrame:
    """The fixed weight of every entity (weights: entity, static_weight), else the default."""
    return entities.join(weights, "entity", "left").select(
        "entity", F.coalesce("static_weight", F.lit(K.STATIC_DEFAULT)).cast("double").alias("static_value"))


def velocity_component(*change_sets: DataFrame) -> DataFrame:
    """Mean impact over page and update-page changes (union of every change source)."""
    cols = ["entity", "customer_impact_score"]
    union = change_sets[0].select(*cols)
    for more in change_sets[1:]:
        union = union.unionByName(more.select(*cols))
    return union.groupBy("entity").agg(
        (F.sum("customer_impact_score") / F.count("customer_impact_score")).alias("velocity_value"))


def social_score(tone: Column, focus: Column) -> Column:
    """(tone + focus) / 2 with unknown labels scored 5."""
    return (_lookup(K.TONE_SCORES, tone, K.UNKNOWN_LABEL_SCORE)
            + _lookup(K.FOCUS_SCORES, focus, K.UNKNOWN_LABEL_SCORE)) / F.lit(2.0)


def latest_by_id(df: DataFrame, key: str = "entity", order: str = "id") -> DataFrame:
    """the row with the largest id per key.

    A hash aggregate of the ids (partial per map task, so a hot key sends one row each), joined back to
    the rows: payload is neither sorted nor buffered. Rows that repeat the id are all returned.
    """
    newest = df.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_order"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_order"))
    return df.join(newest, same).select(key, *[c for c in df.columns if c != key])


def social_component(scan_social: DataFrame | None, stored_social: DataFrame) -> DataFrame:
    """This scan's social row, else the latest stored row, else baseline (at the join)."""
    stored = latest_by_id(stored_social.select("entity", "id", "tone_shift", "campaign_focus"))
    stored = stored.select("entity", social_score(F.col("tone_shift"), F.col("campaign_focus")).alias("stored_social"))
    if scan_social is None:
        return stored.withColumnRenamed("stored_social", "social_value")
    now = latest_by_id(scan_social.select("entity", "id", "tone_shift", "campaign_focus")).select(
        "entity", social_score(F.col("tone_shift"), F.col("campaign_focus")).alias("scan_social"))
    return now.join(stored, "entity", "full").select(
        "entity", F.coalesce("scan_social", "stored_social").alias("social_value"))


def latest_offers(offers: DataFrame, n: int = K.OFFERS_IN_SCORE) -> DataFrame:
    """The newest n offers per entity by detected_at (id breaks ties).

    row_number <= n over the entity window is planned as a WindowGroupLimit: every map task keeps
    its own top n per entity before the shuffle, so a hot entity moves n rows per task, not all.
    """
    w = Window.partitionBy("entity").orderBy(F.col("detected_at").desc(), F.col("id").desc())
    return offers.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def offers_component(offers: DataFrame) -> DataFrame:
    """E5: mean aggressiveness score over the latest 10 stored offers."""
    latest = latest_offers(offers.select("entity", "id", "detected_at", "aggressiveness"))
    score = _lookup(K.AGGRESSIVENESS_SCORES, F.col("aggressiveness"), K.UNKNOWN_LABEL_SCORE)
    return latest.groupBy("entity").agg((F.sum(score) / F.count(F.lit(1))).alias("offers_value"))


def review_component(sentiment: DataFrame) -> DataFrame:
    """Severity of the entity's latest review analysis (baseline 5.0 at the join)."""
    latest = latest_by_id(sentiment.select("entity", "id", "severity_score"))
    return latest.select("entity", F.col("severity_score").alias("review_value"))


def composite_score(roster: DataFrame, review: DataFrame, news: DataFrame, velocity: DataFrame,
                    social: DataFrame, offers: DataFrame) -> DataFrame:
    """E3 + E6: weighted sum of the six unrounded components, clamped to 1..10 and rounded to one
    decimal; the stored components are rounded to one decimal."""
    w = K.SIGNAL_WEIGHTS
    j = (roster.select("pos", "entity", "static_weight")
         .join(review, "entity", "left").join(news, "entity", "left")
         .join(velocity, "entity", "left").join(social, "entity", "left")
         .join(offers, "entity", "left"))
    rv = F.coalesce(F.col("review_value").cast("double"), F.lit(K.REVIEW_BASELINE))
    nv = F.coalesce(F.col("news_value").cast("double"), F.lit(K.NEWS_BASELINE))
    vv = F.coalesce(F.col("velocity_value").cast("double"), F.lit(K.VELOCITY_BASELINE))
    sv = F.coalesce(F.col("static_weight"), F.lit(K.STATIC_DEFAULT)).cast("double")
    so = F.coalesce(F.col("social_value").cast("double"), F.lit(K.SOCIAL_BASELINE))
    of = F.coalesce(F.col("offers_value").cast("double"), F.lit(K.OFFERS_BASELINE))
    total = (F.lit(w["review"]) * rv + F.lit(w["news"]) * nv + F.lit(w["velocity"]) * vv
             + F.lit(w["static"]) * sv + F.lit(w["social"]) * so + F.lit(w["offers"]) * of)
    return j.select(
        "pos", "entity",
        S.round1(S.clamp(total, 1.0, 10.0)).alias("threat_score"),
        S.round1(rv).alias("review_component"),
        S.round1(nv).alias("news_component"),
        S.round1(vv).alias("feature_velocity_component"),
        sv.alias("smb_relevance_component"),
        S.round1(so).alias("social_component"),
        S.round1(of).alias("offers_component"),
    )


def delta_text(entity: Column, prior: Column, new: Column) -> Column:
    """First-score sentence, or 'moved from a to b (+d)' with a sign for d >= 0."""
    d = new - prior
    return F.when(prior.isNull(), F.format_string(
        "This is the first recorded threat score for %s: %s/10.", entity, S.fmt1(new))).otherwise(
        F.format_string("%s's threat score moved from %s to %s (%s%s).", entity, S.fmt1(prior), S.fmt1(new),
                        F.when(d >= 0, F.lit("+")).otherwise(F.lit("")), S.fmt1(d)))


def reason_or_default(reason: Column) -> Column:
    """The explanation, or the fixed fallback sentence when there is none."""
    return F.when(F.coalesce(F.trim(reason), F.lit("")) == "", F.lit(K.REASON_FALLBACK)).otherwise(reason)
