"""Readers for the raw Parquet tables and the logical domain tables bound onto them.

The monitoring domain has eleven stored tables (changes, news, offers, social, scores ...). The
driver's test data is generic, so each logical table is a deterministic projection of one raw table.
The same mapping is written as SQL for the DuckDB oracle in `tidewatch.plans.oracle_sql`; the two
must stay in step.

Mapping (as_of = 2024-01-31T00:00:00Z):
  roster        fixed entities E0..E8 (E8 never has rows)
  changes       events: entity E<user_id % 8>, impact 1 + floor(value) % 10, description = title of
                page (event_id % page count)
  offers        events of type purchase / signup
  social        events of type view
  scores        events per (entity, day): score = avg(value) / 10 clamped to 1..10
  news          pages: headline = <title> + ' - ' + source, entity by URL language
  reviews       conversations, user turns
  sentiment     conversations per conv_id
  comparison    events: latest rating per (entity, dimension)
Every row of the raw tables feeds its logical table; nothing is sampled or capped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S

AS_OF = "2024-01-31 00:00:00"

# ---------------------------------------------------------------------------------------------
# FIXED VALUES of the test binding (our own choices; the oracle SQL repeats them).
# ---------------------------------------------------------------------------------------------
ENTITIES = ["E0", "E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8"]
STATIC_WEIGHTS = {f"E{k}": 1 + 3 * k % 10 for k in range(8)}
APP_IDS = {"E0": "app.e0", "E1": "app.e1", "E2": "app.e2", "E3": "app.e3", "E4": "app.e4",
           "E5": "app.e5", "E6": "app.e6"}
NEWS_SOURCES = [
    "Reuters", "Bloomberg", "The Wall Street Journal", "The Globe and Mail", "Financial Post",
    "TechCrunch", "CNBC", "The Verge", "Axios", "Forbes", "Yahoo Finance", "Yahoo! Finance Canada",
    "BetaKit", "MarketWatch", "PYMNTS", "City Daily",
]
LANG_ENTITY = {"en": "E0", "fr": "E1", "de": "E2", "es": "E3"}
CHANGE_TYPE_OF_EVENT = {"click": "UX", "view": "feature", "purchase": "pricing", "signup": "policy",
                        "error": "feature"}
PAGE_TYPES = ["Pricing", "Product", "product_updates"]
AGGRESSIVENESS_BINDING = ["High", "Medium", "Low", "Unrated"]
TONE_BINDING = ["More aggressive", "Stable", "Retreating", "Unclear"]
FOCUS_BINDING = ["Product launch", "Merchant acquisition", "Brand awareness", "Thought leadership",
                 "Community"]
UNAVAILABLE_REASON = K.REASON_FALLBACK


def _pick(values: list, index: Column) -> Column:
    """values[index] for a non-negative integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def _map(mapping: dict, key: Column, default=None) -> Column:
    out = F.lit(default)
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(out) if expr is not None else out


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


@dataclass
class Raw:
    """Lazy readers for the driver's Parquet tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as an inline VALUES relation (a local scan, no Python job)."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = [f.strip().split(" ", 1)[1] for f in schema.split(",")]

    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"CAST({v} AS {t})"

    values = ", ".join("(" + ", ".join(lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def roster(spark: SparkSession) -> DataFrame:
    """Entity roster: position, static weight (NULL -> default), app id (NULL -> no app)."""
    rows = [(i, e, STATIC_WEIGHTS.get(e), APP_IDS.get(e)) for i, e in enumerate(ENTITIES)]
    return literal_table(spark, rows, "pos int, entity string, static_weight int, app_id string")


def page_titles(raw: Raw) -> DataFrame:
    pages = raw.table("pages")
    return pages.select(
        "page_id", "url",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang"),
    )


def _event_entity() -> Column:
    return F.concat(F.lit("E"), (F.col("user_id") % 8).cast("string"))


def changes(raw: Raw, with_text: bool = True) -> DataFrame:
    """website_changes: one row per event."""
    ev = raw.table("events")
    out = ev.select(
        F.col("event_id").alias("id"),
        _event_entity().alias("entity"),
        F.date_trunc("second", "ts").alias("detected_at"),
        _pick(PAGE_TYPES, F.col("event_id")).alias("page_type"),
        _map(CHANGE_TYPE_OF_EVENT, F.col("event_type")).alias("change_type"),
        (F.lit(1) + F.floor("value").cast("long") % 10).cast("int").alias("customer_impact_score"),
        _pick(K.REVENUE_SENSITIVITY_LEVELS, F.col("event_id")).alias("revenue_sensitivity"),
        _pick(K.SEGMENTS_AFFECTED, F.col("event_id")).alias("segment_affected"),
    )
    if not with_text:
        return out
    return describe(raw, out)


def describe(raw: Raw, changes_df: DataFrame) -> DataFrame:
    """Attach description and url to change rows (id -> page id % page count). Reads apply their
    top-N first and describe only the surviving rows."""
    pages = page_titles(raw)
    # page count from Parquet metadata (no data scan); the binding cycles events over all pages
    n_pages = max(raw.table("pages").count(), 1)
    return changes_df.join(
        pages.select(F.col("page_id"), F.col("title").alias("description"), F.col("url")),
        (changes_df["id"] % n_pages) == F.col("page_id"), "left",
    ).drop("page_id")


def offers(raw: Raw) -> DataFrame:
    ev = raw.table("events").filter(F.col("event_type").isin("purchase", "signup"))
    return ev.select(
        F.col("event_id").alias("id"),
        _event_entity().alias("entity"),
        F.date_trunc("second", "ts").alias("detected_at"),
        _pick(K.OFFER_TYPES, F.col("event_id")).alias("offer_type"),
        _pick(K.OFFER_TARGET_SEGMENTS, F.col("event_id")).alias("target_segment"),
        _pick(AGGRESSIVENESS_BINDING, F.col("event_id")).alias("aggressiveness"),
        _pick(K.OFFER_DURATIONS, F.col("event_id")).alias("duration"),
        _pick(K.OFFER_MATCH_VALUES, F.col("event_id")).alias("home_match"),
        F.concat(F.lit("offer "), F.col("event_id").cast("string")).alias("description"),
    )


def social(raw: Raw) -> DataFrame:
    ev = raw.table("events").filter(F.col("event_type") == "view")
    return ev.select(
        F.col("event_id").alias("id"),
        _event_entity().alias("entity"),
        F.date_trunc("second", "ts").alias("scanned_at"),
        _pick(TONE_BINDING, F.col("event_id")).alias("tone_shift"),
        _pick(FOCUS_BINDING, F.col("event_id")).alias("campaign_focus"),
        F.concat(F.lit("theme "), (F.col("event_id") % 7).cast("string")).alias("messaging_theme"),
        F.array(_pick(K.SEGMENTS_AFFECTED, F.col("event_id"))).alias("target_segment_signals"),
        F.concat(F.lit("opportunity "), F.col("event_id").cast("string")).alias("opportunity"),
        (F.col("event_id") % 11).cast("int").alias("mention_count"),
        F.when(F.col("event_id") % 3 == 0, F.array().cast("array<struct<video_id:string,title:string,url:string,published_at:string,thumbnail_url:string,description:string>>"))
         .otherwise(F.array(F.struct(
             F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("video_id"),
             F.concat(F.lit("video "), F.col("event_id").cast("string")).alias("title"),
             F.concat(F.lit("https://video.example/"), F.col("event_id").cast("string")).alias("url"),
             S.iso_seconds(F.date_trunc("second", "ts")).alias("published_at"),
             F.lit("").alias("thumbnail_url"),
             F.lit("").alias("description")))).alias("videos"),
    )


def scores(raw: Raw) -> DataFrame:
    """threat_scores: one row per (entity, day) of events."""
    ev = raw.table("events")
    g = ev.groupBy(
        (F.col("user_id") % 8).cast("int").alias("eno"),
        F.to_date("ts").alias("day"),
    ).agg(
        F.avg("value").alias("avg_value"),
        F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.date_trunc("second", "ts")).alias("scanned_at"),
    )
    entity = F.concat(F.lit("E"), F.col("eno").cast("string"))
    return g.select(
        (F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long") * 10 + F.col("eno")).alias("id"),
        entity.alias("entity"),
        "scanned_at",
        S.round1(S.clamp(F.col("avg_value") / 10.0, 1.0, 10.0)).alias("threat_score"),
        S.round1(S.clamp(F.col("avg_value") / 8.0, 1.0, 10.0)).alias("review_component"),
        S.round1(S.clamp(F.col("n") / 4.0, 1.0, 10.0)).alias("news_component"),
        S.round1(S.clamp(F.col("max_value") / 50.0, 1.0, 10.0)).alias("feature_velocity_component"),
        F.coalesce(_map(STATIC_WEIGHTS, entity), F.lit(K.STATIC_DEFAULT)).cast("double").alias("smb_relevance_component"),
        F.when(F.col("n") % 4 == 0, F.lit(None).cast("double")).otherwise(
            S.round1(S.clamp(F.col("avg_value") / 12.0, 1.0, 10.0))).alias("social_component"),
        F.when(F.col("n") % 6 == 0, F.lit(None).cast("double")).otherwise(
            S.round1(S.clamp(F.col("avg_value") / 15.0, 1.0, 10.0))).alias("offers_component"),
        F.when(F.col("n") % 5 == 0, F.lit(UNAVAILABLE_REASON)).otherwise(
            F.concat(F.lit("Moved on "), F.col("n").cast("string"), F.lit(" signals."))).alias("reason"),
    )


def news(raw: Raw) -> DataFrame:
    """news_articles: one row per page."""
    p = page_titles(raw)
    pid = F.col("page_id")
    source = _pick(NEWS_SOURCES, pid)
    pub = as_of() - F.make_interval(days=(pid % 120).cast("int")) + F.make_interval(hours=(pid % 24).cast("int"))
    kind = (pid % 16).cast("int")
    fmt = (pid % 8).cast("int")
    published = (
        F.when(kind == 7, F.lit(None).cast("string"))
        .when(kind == 15, F.lit(""))
        .when(fmt == 0, F.concat(F.date_format(pub, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(fmt == 1, F.concat(F.date_format(pub + F.expr("INTERVAL 2 HOURS"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .when(fmt == 2, F.date_format(pub, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(fmt == 3, F.concat(F.date_format(pub - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
        .when(fmt == 4, F.date_format(pub, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(fmt == 5, F.date_format(pub, "yyyy-MM-dd"))
        .otherwise(F.lit("yesterday"))
    )
    return p.select(
        pid.alias("id"),
        _map(LANG_ENTITY, F.col("lang"), "E4").alias("entity"),
        F.concat(F.col("title"), F.lit(" - "), source).alias("headline"),
        source.alias("source"),
        F.col("url"),
        published.alias("published_at"),
        (as_of() - F.make_interval(mins=(pid % 1000).cast("int"))).alias("fetched_at"),
        _pick(K.NEWS_IMPACT_TYPES, pid).alias("impact_type"),
        (F.lit(1) + pid % 10).cast("int").alias("relevance"),
        _pick(K.MARKET_IMPACTS, pid).alias("market_impact"),
        F.col("title").alias("summary"),
        S.source_weight(source).alias("source_weight"),
    )


def reviews(raw: Raw) -> DataFrame:
    """Raw app reviews: user turns of conversations."""
    c = raw.table("conversations").filter(F.col("role") == "user")
    entity = F.concat(F.lit("E"), (F.col("conv_id") % 8).cast("string"))
    return c.select(
        entity.alias("entity"),
        _map(APP_IDS, entity).alias("app_id"),
        F.when(F.col("turn") % 3 == 2, F.lit(None).cast("string")).otherwise(
            F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))).alias("review_id"),
        F.col("text").alias("content"),
        F.when(F.col("conv_id") % 6 == 0, F.lit(None).cast("int")).otherwise((F.col("conv_id") % 6).cast("int")).alias("score"),
        (as_of() - F.make_interval(days=(F.col("conv_id") % 40).cast("int"), hours=F.col("turn").cast("int"))).alias("reviewed_at"),
    ).filter(F.col("app_id").isNotNull())


def sentiment(raw: Raw) -> DataFrame:
    """review_sentiment: one row per conversation."""
    c = raw.table("conversations")
    g = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.length("text")).alias("avg_len"),
        F.max("turn").alias("max_turn"),
    )
    return g.select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit("E"), (F.col("conv_id") % 8).cast("string")).alias("entity"),
        (as_of() - F.make_interval(days=(F.col("conv_id") % 40).cast("int"))).alias("scanned_at"),
        _pick(K.SENTIMENTS, F.col("conv_id")).alias("sentiment"),
        S.round1(S.clamp(F.col("avg_len") / 100.0, 1.0, 10.0)).alias("severity_score"),
        F.array(F.lit("theme"), F.concat(F.lit("turns "), F.col("n").cast("string"))).alias("themes"),
        F.array(F.concat(F.lit("complaint "), F.col("conv_id").cast("string")),
                F.lit("slow support"), F.lit("fees")).alias("top_complaints"),
        F.array(F.concat(F.lit("praise "), F.col("conv_id").cast("string"))).alias("top_praise"),
        F.concat(F.lit("opportunity "), F.col("conv_id").cast("string")).alias("opportunity"),
        F.col("n").cast("int").alias("review_count"),
    )


def comparison(raw: Raw) -> DataFrame:
    """comparison facts in long form: every event rates one (entity, dimension)."""
    ev = raw.table("events")
    return ev.select(
        F.col("event_id").alias("id"),
        _event_entity().alias("entity"),
        _pick(K.COMPARISON_DIMENSIONS, F.col("event_id")).alias("dimension"),
        _pick(K.COMPARISON_RATINGS, F.floor("value").cast("long")).alias("rating"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("note"),
    )


THREAT_LEVEL_BINDING = ["High", "Medium", "Low"]
HISTORY_TYPES = ["pricing_change", "product_launch", "policy_change", "funding"]


def products(raw: Raw) -> DataFrame:
    """product_intelligence: the update-page layer of changes mapped to a home product."""
    ch = changes(raw).filter(F.col("page_type") == "product_updates")
    rid = F.col("id")
    return ch.select(
        "id", "entity", "detected_at", "url",
        F.col("description").alias("raw_change"),
        F.concat(F.lit("move "), rid.cast("string")).alias("move"),
        _pick(K.HOME_PRODUCTS, rid).alias("home_product"),
        F.when(rid % 13 == 0, F.lit(None).cast("string")).otherwise(_pick(THREAT_LEVEL_BINDING, rid)).alias("threat_level"),
        F.when(rid % 29 == 0, F.lit("")).when(rid % 31 == 0, F.lit(" : ")).otherwise(
            F.concat(F.lit("Review "), F.col("change_type"))).alias("recommended_action"),
        F.col("detected_at").alias("analyzed_at"),
    )


def history(raw: Raw) -> DataFrame:
    """historical_events: error events as dated market events."""
    ev = raw.table("events").filter(F.col("event_type") == "error")
    rid = F.col("event_id")
    return ev.select(
        rid.alias("id"),
        _event_entity().alias("entity"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_date"),
        _pick(HISTORY_TYPES, rid).alias("event_type"),
        F.concat(F.lit("event "), rid.cast("string")).alias("description"),
        F.concat(F.lit("news"), (rid % 5).cast("string"), F.lit(".example.com")).alias("source"),
        (F.lit(5) + rid % 4).cast("int").alias("impact_score"),
    )


LAYERS = ["page", "update", "offer"]
LAYER_PREFIX = {"page": "", "update": "product_updates::", "offer": "offers::"}


def watched_pages(raw: Raw) -> DataFrame:
    """Watch roster joined with the fetched HTML: entity by URL language, a layer per page, and the
    layered snapshot key (A2)."""
    p = raw.table("pages")
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    layer = _pick(LAYERS, F.col("page_id"))
    key = F.concat(_map(LAYER_PREFIX, layer, ""), F.lit("p"), F.col("page_id").cast("string"))
    return p.select("page_id", _map(LANG_ENTITY, lang, "E4").alias("entity"), layer.alias("layer"),
                    key.alias("page_key"), "url", "html")
