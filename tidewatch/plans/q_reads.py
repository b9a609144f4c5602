"""Registered queries for the read operators (F1-F10), dashboard views (G1-G16) and maintenance (H1-H2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import maintenance as H
from ..operators import reads as R
from ..operators import views as G
from ..sources import tables as T
from . import sql_bindings as B
from .registry import query


def _iso(df, *cols):
    """Timestamps leave as the stored ISO text form."""
    return df.select(*[S.iso_seconds(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _raw(spark, sf_dir):
    return T.Raw(spark, sf_dir)


ISO = B.iso_seconds

# ---------------------------------------------------------------------------------------------- F2
_CH_COLS = ["id", "entity", "detected_at", "change_type", "customer_impact_score", "segment_affected", "description"]
_CH_SQL = f"id, entity, {ISO('detected_at')} AS detected_at, change_type, customer_impact_score, segment_affected, description"


@query("f2_changes", B.with_ctes(
    f"SELECT {_CH_SQL} FROM b_changes ORDER BY detected_at DESC, id DESC LIMIT 100", ["b_changes"]))
def f2_changes(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    top = R.changes(T.changes(raw, with_text=False), 100)
    return _iso(T.describe(raw, top).select(*_CH_COLS), "detected_at")


@query("f2_changes_filtered", B.with_ctes(
    f"SELECT {_CH_SQL} FROM b_changes WHERE entity = 'E3' AND change_type = 'pricing' "
    "ORDER BY detected_at DESC, id DESC LIMIT 100", ["b_changes"]))
def f2_changes_filtered(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    df = R.changes(T.changes(raw, with_text=False), 100, entity="E3", change_type="pricing")
    return _iso(T.describe(raw, df).select(*_CH_COLS), "detected_at")


# ---------------------------------------------------------------------------------------------- F3
_PR_SQL = f"id, entity, home_product, threat_level, {ISO('analyzed_at')} AS analyzed_at, raw_change"


@query("f3_product_rows", B.with_ctes(
    f"SELECT {_PR_SQL} FROM b_products ORDER BY analyzed_at DESC, id DESC LIMIT 500", ["b_products"]))
def f3_product_rows(spark, sf_dir):
    df = R.product_rows(T.products(_raw(spark, sf_dir)), 500)
    return _iso(df.select("id", "entity", "home_product", "threat_level", "analyzed_at", "raw_change"), "analyzed_at")


@query("f3_product_rows_filtered", B.with_ctes(
    f"SELECT {_PR_SQL} FROM b_products WHERE entity = 'E1' AND home_product = {B.q(K.GAP_LABEL)} "
    "ORDER BY analyzed_at DESC, id DESC LIMIT 500", ["b_products"]))
def f3_product_rows_filtered(spark, sf_dir):
    df = R.product_rows(T.products(_raw(spark, sf_dir)), 500, entity="E1", home_product=K.GAP_LABEL)
    return _iso(df.select("id", "entity", "home_product", "threat_level", "analyzed_at", "raw_change"), "analyzed_at")


# ---------------------------------------------------------------------------------------------- F4
_OF_COLS = ["id", "entity", "detected_at", "offer_type", "target_segment", "aggressiveness", "home_match"]
_OF_SQL = f"id, entity, {ISO('detected_at')} AS detected_at, offer_type, target_segment, aggressiveness, home_match"


@query("f4_offers", B.with_ctes(
    f"SELECT {_OF_SQL} FROM b_offers ORDER BY detected_at DESC, id DESC LIMIT 500", ["b_offers"]))
def f4_offers(spark, sf_dir):
    return _iso(R.offers(T.offers(_raw(spark, sf_dir)), 500).select(*_OF_COLS), "detected_at")


@query("f4_offers_filtered", B.with_ctes(
    f"SELECT {_OF_SQL} FROM b_offers WHERE entity = 'E2' AND offer_type = 'free_trial' AND target_segment = 'SMB' "
    "ORDER BY detected_at DESC, id DESC LIMIT 500", ["b_offers"]))
def f4_offers_filtered(spark, sf_dir):
    df = R.offers(T.offers(_raw(spark, sf_dir)), 500, entity="E2", offer_type="free_trial", segment="SMB")
    return _iso(df.select(*_OF_COLS), "detected_at")


# ---------------------------------------------------------------------------------------------- F5
_NW_COLS = ["id", "entity", "headline", "source", "relevance", "impact_type", "fetched_at", "published_at"]
_NW_SQL = f"id, entity, headline, source, relevance, impact_type, {ISO('fetched_at')} AS fetched_at, published_at"


@query("f5_news", B.with_ctes(
    f"SELECT {_NW_SQL} FROM b_news ORDER BY relevance DESC, fetched_at DESC, id DESC LIMIT 100", ["b_news"]))
def f5_news(spark, sf_dir):
    return _iso(R.news(T.news(_raw(spark, sf_dir)), 100).select(*_NW_COLS), "fetched_at")


@query("f5_news_filtered", B.with_ctes(
    f"SELECT {_NW_SQL} FROM b_news WHERE entity = 'E0' AND impact_type = 'funding' "
    "ORDER BY relevance DESC, fetched_at DESC, id DESC LIMIT 100", ["b_news"]))
def f5_news_filtered(spark, sf_dir):
    df = R.news(T.news(_raw(spark, sf_dir)), 100, entity="E0", impact_type="funding")
    return _iso(df.select(*_NW_COLS), "fetched_at")


# ---------------------------------------------------------------------------------------------- F6 / F7
@query("f6_latest_social", B.with_ctes(
    f"SELECT entity, max(id) AS id, arg_max(tone_shift, id) AS tone_shift, arg_max(campaign_focus, id) AS campaign_focus, "
    f"arg_max({ISO('scanned_at')}, id) AS scanned_at FROM b_social GROUP BY entity", ["b_social"]))
def f6_latest_social(spark, sf_dir):
    df = T.social(_raw(spark, sf_dir)).select("entity", "id", "tone_shift", "campaign_focus", "scanned_at")
    return _iso(R.latest_per_entity(df), "scanned_at")


@query("f6_latest_sentiment", B.with_ctes(
    "SELECT entity, max(id) AS id, arg_max(sentiment, id) AS sentiment, arg_max(severity_score, id) AS severity_score "
    "FROM b_sentiment GROUP BY entity", ["b_sentiment"]))
def f6_latest_sentiment(spark, sf_dir):
    df = T.sentiment(_raw(spark, sf_dir)).select("entity", "id", "sentiment", "severity_score")
    return R.latest_per_entity(df)


@query("f6_latest_score", B.with_ctes(
    f"SELECT entity, max(id) AS id, arg_max(threat_score, id) AS threat_score, arg_max({ISO('scanned_at')}, id) AS scanned_at "
    "FROM b_scores GROUP BY entity", ["b_scores"]))
def f6_latest_score(spark, sf_dir):
    df = T.scores(_raw(spark, sf_dir)).select("entity", "id", "threat_score", "scanned_at")
    return _iso(R.latest_per_entity(df), "scanned_at")


@query("f7_previous_score", B.with_ctes(
    f"SELECT entity, id, threat_score, {ISO('scanned_at')} AS scanned_at FROM (SELECT *, row_number() OVER "
    "(PARTITION BY entity ORDER BY id DESC) AS rn FROM b_scores) WHERE rn = 2", ["b_scores"]))
def f7_previous_score(spark, sf_dir):
    df = T.scores(_raw(spark, sf_dir)).select("entity", "id", "threat_score", "scanned_at")
    return _iso(R.previous_per_entity(df), "scanned_at")


# ---------------------------------------------------------------------------------------------- F8 - F10
@query("f8_score_history", B.with_ctes(
    f"SELECT id, entity, {ISO('scanned_at')} AS scanned_at, threat_score FROM b_scores WHERE entity = 'E5'", ["b_scores"]))
def f8_score_history(spark, sf_dir):
    df = R.score_history(T.scores(_raw(spark, sf_dir)), entity="E5")
    return _iso(df.select("id", "entity", "scanned_at", "threat_score"), "scanned_at")


@query("f9_latest_score_row", B.with_ctes(
    f"SELECT id, entity, threat_score, {ISO('scanned_at')} AS scanned_at FROM b_scores ORDER BY id DESC LIMIT 1", ["b_scores"]))
def f9_latest_score_row(spark, sf_dir):
    df = R.latest_row(T.scores(_raw(spark, sf_dir)).select("id", "entity", "threat_score", "scanned_at"))
    return _iso(df, "scanned_at")


@query("f10_events", B.with_ctes(
    "SELECT id, entity, event_date, event_type, impact_score FROM b_history WHERE entity = 'E2'", ["b_history"]))
def f10_events(spark, sf_dir):
    return R.events(T.history(_raw(spark, sf_dir)), entity="E2").select(
        "id", "entity", "event_date", "event_type", "impact_score")


@query("f10_event_count", B.with_ctes("SELECT count(*) AS n_events FROM b_history", ["b_history"]))
def f10_event_count(spark, sf_dir):
    return R.event_count(T.history(_raw(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------- G1
def _kpi_sql() -> str:
    d = "(s1.threat_score - s2.threat_score)"
    band = ("CASE WHEN s1.threat_score IS NULL THEN 'grey' WHEN s1.threat_score >= 7 THEN 'high' "
            "WHEN s1.threat_score >= 4 THEN 'mid' ELSE 'low' END")
    trend = (f"CASE WHEN s1.threat_score IS NULL THEN 'no data' WHEN s2.threat_score IS NULL THEN 'first scan' "
             f"WHEN {d} > {K.TREND_EPSILON} THEN 'up' WHEN {d} < -{K.TREND_EPSILON} THEN 'down' ELSE 'stable' END")
    label = (f"CASE WHEN s2.threat_score IS NULL THEN NULL WHEN {d} > {K.TREND_EPSILON} THEN '+' || {B.fmt1(d)} "
             f"WHEN {d} < -{K.TREND_EPSILON} THEN {B.fmt1(d)} ELSE NULL END")
    sql = (f"SELECT r.pos, r.entity, s1.threat_score AS score, {band} AS band, {trend} AS trend, {label} AS delta_label "
           "FROM b_roster r LEFT JOIN ranked s1 ON s1.entity = r.entity AND s1.rn = 1 "
           "LEFT JOIN ranked s2 ON s2.entity = r.entity AND s2.rn = 2")
    extra = {"ranked": ("SELECT entity, threat_score, row_number() OVER (PARTITION BY entity ORDER BY id DESC) AS rn "
                        "FROM b_scores", ["b_scores"])}
    return B.with_ctes(sql, ["b_roster", "ranked"], extra)


@query("g1_kpi_strip", _kpi_sql())
def g1_kpi_strip(spark, sf_dir):
    return G.kpi_strip(T.roster(spark), T.scores(_raw(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------- G2
def _band_sql(x, hi, mid, lo, null):
    return (f"CASE WHEN TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) IS NULL THEN '{null}' WHEN {x} >= 7 THEN '{hi}' "
            f"WHEN {x} >= 4 THEN '{mid}' ELSE '{lo}' END")


@query("g2_bands", B.with_ctes(
    f"SELECT id, {_band_sql('threat_score', 'high', 'mid', 'low', 'grey')} AS score_band, "
    f"{_band_sql('review_component', 'good', 'mid', 'bad', 'grey')} AS severity_band, "
    f"{_band_sql('feature_velocity_component', 'high', 'mid', 'low', 'mid')} AS impact_band, "
    f"{_band_sql('news_component', 'High', 'Medium', 'Low', 'Low')} AS relevance_level FROM b_scores", ["b_scores"]))
def g2_bands(spark, sf_dir):
    sc = T.scores(_raw(spark, sf_dir))
    return sc.select("id", S.score_band("threat_score").alias("score_band"),
                     S.severity_band("review_component").alias("severity_band"),
                     S.impact_band("feature_velocity_component").alias("impact_band"),
                     S.relevance_level("news_component").alias("relevance_level"))


# ---------------------------------------------------------------------------------------------- G3 / G4 without the fold
@query("g3_changes_view_nodedup", B.with_ctes(
    f"SELECT {_CH_SQL} FROM (SELECT * FROM b_changes ORDER BY detected_at DESC, id DESC LIMIT 500) "
    f"WHERE customer_impact_score >= 2 AND detected_at >= {B.AS_OF} - INTERVAL 90 DAY AND segment_affected = 'SMB'",
    ["b_changes"]))
def g3_changes_view_nodedup(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    df = G.changes_view(T.changes(raw, with_text=False), T.as_of(), segment="SMB")
    return _iso(T.describe(raw, df).select(*_CH_COLS), "detected_at")


def _news_window_sql(where_extra: str = "") -> str:
    pub = B.lenient_timestamp("published_at")
    return (f"SELECT * FROM (SELECT * FROM b_news {where_extra} ORDER BY relevance DESC, fetched_at DESC, id DESC LIMIT 500) "
            f"WHERE {pub} IS NULL OR {pub} >= {B.AS_OF} - INTERVAL 90 DAY")


@query("g4_news_view_nodedup", B.with_ctes(
    f"SELECT {_NW_SQL} FROM ({_news_window_sql()}) WHERE relevance >= 7", ["b_news"]))
def g4_news_view_nodedup(spark, sf_dir):
    df = G.news_view(T.news(_raw(spark, sf_dir)), T.as_of(), level="High")
    return _iso(df.select(*_NW_COLS), "fetched_at")


# ---------------------------------------------------------------------------------------------- G5
@query("g5_reviews_view", B.with_ctes(
    "SELECT r.pos, r.entity, r.app_id, l.sentiment, l.severity_score, "
    f"CASE WHEN l.id IS NULL THEN NULL ELSE {_band_sql('l.severity_score', 'good', 'mid', 'bad', 'grey')} END AS severity_band, "
    "array_to_string(coalesce(l.themes, []), ', ') AS themes, len(coalesce(l.top_complaints, [])) AS n_complaints, "
    "len(coalesce(l.top_praise, [])) AS n_praise, "
    "CASE WHEN l.id IS NULL AND r.app_id IS NULL THEN 'No app available for this entity.' "
    "WHEN l.id IS NULL THEN 'No review data yet.' ELSE NULL END AS message "
    "FROM b_roster r LEFT JOIN (SELECT entity, max(id) AS id, arg_max(sentiment, id) AS sentiment, "
    "arg_max(severity_score, id) AS severity_score, arg_max(themes, id) AS themes, arg_max(top_complaints, id) AS top_complaints, "
    "arg_max(top_praise, id) AS top_praise FROM b_sentiment GROUP BY entity) l ON l.entity = r.entity",
    ["b_roster", "b_sentiment"]))
def g5_reviews_view(spark, sf_dir):
    return G.reviews_view(T.roster(spark), T.sentiment(_raw(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------- G6 / D7
_CELLS_SQL = ("SELECT entity, dimension, arg_max(rating, id) AS rating, arg_max(note, id) AS note "
              "FROM b_comparison GROUP BY entity, dimension")


@query("d7_flatten_comparison", B.with_ctes(_CELLS_SQL, ["b_comparison"]))
def d7_flatten_comparison(spark, sf_dir):
    return G.comparison_cells(T.comparison(_raw(spark, sf_dir)))


def _matrix_sql() -> str:
    icon = ("CASE WHEN rating = 'green' THEN '✓' WHEN rating = 'yellow' THEN '≈' "
            "WHEN rating = 'red' THEN '✗' ELSE '?' END")
    cols = ", ".join(f"coalesce(max(CASE WHEN c.entity = {B.q(e)} THEN {icon} END), '—') AS {e}" for e in T.ENTITIES)
    dims = ", ".join(f"({i}, {B.q(d)})" for i, d in enumerate(K.COMPARISON_DIMENSIONS))
    sql = (f"SELECT d.dim_pos, d.dimension, {cols} FROM (VALUES {dims}) d(dim_pos, dimension) "
           "LEFT JOIN cells c ON c.dimension = d.dimension GROUP BY d.dim_pos, d.dimension")
    return B.with_ctes(sql, ["cells"], {"cells": (_CELLS_SQL, ["b_comparison"])})


@query("g6_comparison_matrix", _matrix_sql())
def g6_comparison_matrix(spark, sf_dir):
    cells = G.comparison_cells(T.comparison(_raw(spark, sf_dir)))
    return G.comparison_matrix(spark, cells, T.ENTITIES)


# ---------------------------------------------------------------------------------------------- G7 / G8
@query("g7_trend_latest", B.with_ctes(
    f"SELECT entity, id, {ISO('scanned_at')} AS scanned_at, threat_score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY entity ORDER BY scanned_at DESC, id ASC) AS rn FROM b_scores) WHERE rn = 1", ["b_scores"]))
def g7_trend_latest(spark, sf_dir):
    df = G.trend_latest(T.scores(_raw(spark, sf_dir)).select("entity", "id", "scanned_at", "threat_score"))
    return _iso(df, "scanned_at")


@query("g8_score_table", B.with_ctes(
    "SELECT r.pos, r.entity, s.threat_score, s.review_component, s.news_component, s.feature_velocity_component, "
    f"s.smb_relevance_component, coalesce(s.social_component, {K.SOCIAL_BASELINE}) AS social_component, "
    f"coalesce(s.offers_component, {K.OFFERS_BASELINE}) AS offers_component, s.reason, "
    f"substr({ISO('s.scanned_at')}, 1, 10) AS date FROM b_roster r JOIN (SELECT * FROM (SELECT *, row_number() OVER "
    "(PARTITION BY entity ORDER BY id DESC) AS rn FROM b_scores) WHERE rn = 1) s ON s.entity = r.entity",
    ["b_roster", "b_scores"]))
def g8_score_table(spark, sf_dir):
    return G.score_table(T.roster(spark), T.scores(_raw(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------- G9 / G10
_TOP_PR = "(SELECT * FROM b_products ORDER BY analyzed_at DESC, id DESC LIMIT 1000)"


@query("g9_product_view", B.with_ctes(
    f"SELECT {_PR_SQL} FROM {_TOP_PR} WHERE entity = 'E4' AND home_product = 'Developer tools'", ["b_products"]))
def g9_product_view(spark, sf_dir):
    df = G.product_view(T.products(_raw(spark, sf_dir)), entity="E4", home_product="Developer tools")
    return _iso(df.select("id", "entity", "home_product", "threat_level", "analyzed_at", "raw_change"), "analyzed_at")


@query("g9_product_entities", B.with_ctes(f"SELECT DISTINCT entity FROM {_TOP_PR}", ["b_products"]))
def g9_product_entities(spark, sf_dir):
    return G.product_entities(T.products(_raw(spark, sf_dir)))


@query("g10_product_gaps", B.with_ctes(
    f"SELECT {_PR_SQL} FROM {_TOP_PR} WHERE home_product = {B.q(K.GAP_LABEL)}", ["b_products"]))
def g10_product_gaps(spark, sf_dir):
    df = G.product_gaps(T.products(_raw(spark, sf_dir)))
    return _iso(df.select("id", "entity", "home_product", "threat_level", "analyzed_at", "raw_change"), "analyzed_at")


# ---------------------------------------------------------------------------------------------- G11
def _social_cards_sql() -> str:
    disp = (f"CASE WHEN {B.lenient_timestamp('v.published_at')} IS NOT NULL THEN "
            f"strftime({B.lenient_timestamp('v.published_at')}, '%b %d, %Y') ELSE substr(coalesce(v.published_at, ''), 1, 10) END")
    sql = ("SELECT r.pos, l.entity, l.id, l.campaign_focus, l.tone_shift, array_to_string(l.target_segment_signals, ', ') AS segments, "
           f"l.mention_count, v.video_id, v.title AS video_title, CASE WHEN v.video_id IS NULL THEN NULL ELSE {disp} END AS video_date "
           "FROM b_roster r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY id DESC) AS rn "
           "FROM b_social) WHERE rn = 1) l ON l.entity = r.entity "
           "LEFT JOIN LATERAL (SELECT unnest(l.videos, recursive := true)) v ON true")
    return B.with_ctes(sql, ["b_roster", "b_social"])


@query("g11_social_cards", _social_cards_sql())
def g11_social_cards(spark, sf_dir):
    df = G.social_cards(T.roster(spark), T.social(_raw(spark, sf_dir)))
    return df.withColumn("video_date", F.when(F.col("video_id").isNull(), F.lit(None).cast("string")).otherwise(F.col("video_date")))


# ---------------------------------------------------------------------------------------------- G12 / G13
_TOP_OF = "(SELECT * FROM b_offers ORDER BY detected_at DESC, id DESC LIMIT 1000)"


@query("g12_offers_view", B.with_ctes(
    f"SELECT {_OF_SQL} FROM {_TOP_OF} WHERE entity = 'E2' AND offer_type = 'free_trial' AND target_segment = 'New merchants'",
    ["b_offers"]))
def g12_offers_view(spark, sf_dir):
    df = G.offers_view(T.offers(_raw(spark, sf_dir)), entity="E2", offer_type="free_trial", segment="New merchants")
    return _iso(df.select(*_OF_COLS), "detected_at")


@query("g13_offer_gaps", B.with_ctes(
    f"SELECT {_OF_SQL} FROM {_TOP_OF} WHERE entity = 'E0' AND home_match IN ('No', 'Partial')", ["b_offers"]))
def g13_offer_gaps(spark, sf_dir):
    return _iso(G.offer_gaps(T.offers(_raw(spark, sf_dir)), entity="E0").select(*_OF_COLS), "detected_at")


# ---------------------------------------------------------------------------------------------- G15 / K2 / K3 / K4
def _display_sql(col: str) -> str:
    p = B.lenient_timestamp(col)
    return f"CASE WHEN {p} IS NOT NULL THEN strftime({p}, '%b %d, %Y') ELSE substr(coalesce({col}, ''), 1, 10) END"


@query("g15_display_dates", B.with_ctes(
    f"SELECT id, published_at, {ISO(B.lenient_timestamp('published_at'))} AS published_ts, "
    f"{ISO(B.iso_or_min('published_at'))} AS iso_or_min, substr(split_part(coalesce(published_at, ''), 'T', 1), 1, 10) AS date_prefix, "
    f"{_display_sql('published_at')} AS display_date FROM b_news", ["b_news"]))
def g15_display_dates(spark, sf_dir):
    n = T.news(_raw(spark, sf_dir))
    return n.select("id", "published_at",
                    S.iso_seconds(S.lenient_timestamp(F.col("published_at"))).alias("published_ts"),
                    S.iso_seconds(S.iso_or_min(F.col("published_at"))).alias("iso_or_min"),
                    S.date_prefix(F.col("published_at")).alias("date_prefix"),
                    S.display_date(F.col("published_at")).alias("display_date"))


# ---------------------------------------------------------------------------------------------- G16 / K6
def _fold_sql(col: str) -> str:
    out = f"coalesce({col}, '')"
    for ch, rep in K.ASCII_FOLD:
        out = f"replace({out}, {B.q(ch)}, {B.q(rep)})"
    return f"regexp_replace({out}, '[^\\x00-\\x{{ff}}]', '?', 'g')"


@query("g16_fold_ascii", f"SELECT doc_id, {_fold_sql('text')} AS text FROM documents")
def g16_fold_ascii(spark, sf_dir):
    d = _raw(spark, sf_dir).table("documents")
    return d.select("doc_id", S.fold_ascii(F.col("text")).alias("text"))


@query("k6_html_escape", "SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), "
                         "'>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS url_html FROM pages")
def k6_html_escape(spark, sf_dir):
    return _raw(spark, sf_dir).table("pages").select("page_id", S.html_escape(F.col("url")).alias("url_html"))


# ---------------------------------------------------------------------------------------------- H1 / H2
_SPECIAL = ("E1", "E1 moved on its latest signals.", "Score moved on this scan's signals.")


@query("h1_rewrite_reasons", B.with_ctes(
    f"SELECT id, entity, CASE WHEN contains(reason, {B.q(K.UNAVAILABLE_MARKER)}) AND entity = 'E1' THEN {B.q(_SPECIAL[1])} "
    f"WHEN contains(reason, {B.q(K.UNAVAILABLE_MARKER)}) THEN {B.q(_SPECIAL[2])} ELSE reason END AS reason FROM b_scores",
    ["b_scores"]))
def h1_rewrite_reasons(spark, sf_dir):
    sc = T.scores(_raw(spark, sf_dir)).select("id", "entity", "reason")
    return H.rewrite_reasons(sc, *_SPECIAL)


@query("h2_delete_before", B.with_ctes(
    f"SELECT count(*) FILTER (WHERE NOT ({ISO('scanned_at')} < {B.q(K.SCORE_CUTOFF)})) AS n_kept, "
    f"count(*) FILTER (WHERE {ISO('scanned_at')} < {B.q(K.SCORE_CUTOFF)}) AS n_deleted FROM b_scores", ["b_scores"]))
def h2_delete_before(spark, sf_dir):
    _, counts = H.delete_before(T.scores(_raw(spark, sf_dir)))
    return counts


_MID_CUTOFF = "2024-01-15T00:00:00+00:00"


@query("h2_kept_after_cutoff", B.with_ctes(
    f"SELECT id, entity, {ISO('scanned_at')} AS scanned_at FROM b_scores WHERE NOT ({ISO('scanned_at')} < {B.q(_MID_CUTOFF)})",
    ["b_scores"]))
def h2_kept_after_cutoff(spark, sf_dir):
    kept, _ = H.delete_before(T.scores(_raw(spark, sf_dir)).select("id", "entity", "scanned_at"), _MID_CUTOFF)
    return _iso(kept, "scanned_at")


# ---------------------------------------------------------------------------------------------- F1 / G7 series / K1
_SNAP_SQL = {"snap": (
    f"SELECT coalesce({B.case_map(T.LANG_ENTITY, 'lang')}, 'E4') AS entity, "
    f"(CASE {B.pick(T.LAYERS, 't.page_id')} WHEN 'update' THEN 'product_updates::' WHEN 'offer' THEN 'offers::' ELSE '' END) "
    "|| 'p' || CAST(t.page_id AS VARCHAR) AS page_key, t.url, t.title AS page_title, sha256(p.html) AS content_hash "
    "FROM b_titles t JOIN pages p ON p.page_id = t.page_id", ["b_titles"])}


@query("f1_snapshot", B.with_ctes("SELECT * FROM snap WHERE entity = 'E0' AND page_key = 'product_updates::p1'",
                                  ["snap"], _SNAP_SQL))
def f1_snapshot(spark, sf_dir):
    """Point lookup of one stored snapshot by (entity, page_key)."""
    raw = _raw(spark, sf_dir)
    w = T.watched_pages(raw).join(T.page_titles(raw).select("page_id", "title"), "page_id")
    snaps = w.select("entity", "page_key", "url", F.col("title").alias("page_title"),
                     S.content_hash(F.col("html")).alias("content_hash"))
    return R.snapshot(snaps, "E0", "product_updates::p1")


@query("g7_trend_series", B.with_ctes(
    f"SELECT entity, id, {ISO('scanned_at')} AS scanned_at, threat_score FROM b_scores", ["b_scores"]))
def g7_trend_series(spark, sf_dir):
    df = R.score_history(T.scores(_raw(spark, sf_dir)))
    return _iso(df.select("entity", "id", "scanned_at", "threat_score"), "scanned_at")


@query("k1_round1", f"SELECT event_id, {B.round1('value / 7.0')} AS r FROM events")
def k1_round1(spark, sf_dir):
    ev = _raw(spark, sf_dir).table("events")
    return ev.select("event_id", S.round1(F.col("value") / 7.0).alias("r"))
