"""Registered queries for the summaries (E8-E10) and the weekly brief.

A scan of the binding is one day: the score table holds one row per (entity, day), which is the
set of (entity, scan) pairs; every signal belongs to the scan of its own date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import summaries as M
from ..operators import views as G
from ..sources import tables as T
from . import sql_bindings as B
from .registry import query


def _scan(df, col):
    return df.withColumn("scan", F.to_date(col))


def _inputs(spark, sf_dir):
    raw = T.Raw(spark, sf_dir)
    scans = _scan(T.scores(raw), "scanned_at")
    return dict(
        scans=scans.select("entity", "scan").distinct(),
        scores=scans,
        changes=_scan(T.changes(raw), "detected_at"),
        sentiment=_scan(T.sentiment(raw), "scanned_at"),
        news=_scan(T.news(raw), "fetched_at"),
        social=_scan(T.social(raw), "scanned_at"),
        offers=_scan(T.offers(raw), "detected_at"),
    )


_SCAN_CTES = {
    "scans": ("SELECT DISTINCT entity, CAST(scanned_at AS DATE) AS scan FROM b_scores", ["b_scores"]),
    "ch": ("SELECT *, CAST(detected_at AS DATE) AS scan FROM b_changes", ["b_changes"]),
    "nw": ("SELECT *, CAST(fetched_at AS DATE) AS scan FROM b_news", ["b_news"]),
    "so": ("SELECT *, CAST(scanned_at AS DATE) AS scan FROM b_social", ["b_social"]),
    "sn": ("SELECT *, CAST(scanned_at AS DATE) AS scan FROM b_sentiment", ["b_sentiment"]),
    "of": ("SELECT *, CAST(detected_at AS DATE) AS scan FROM b_offers", ["b_offers"]),
}


def _signals_sql() -> str:
    themes = "CASE WHEN len(coalesce(x.themes, [])) > 0 THEN array_to_string(x.themes, ', ') ELSE 'none' END"
    parts = [
        "SELECT entity, scan, 1 AS section, id AS pos, '  - (' || change_type || ', impact ' || CAST(customer_impact_score AS VARCHAR) "
        "|| '/10) ' || description AS line FROM ch",
        "SELECT DISTINCT entity, scan, 1, -1, 'Website changes detected this scan:' FROM ch",
        "SELECT entity, scan, 1, -1, 'No website changes detected this scan.' FROM scans s WHERE NOT EXISTS "
        "(SELECT 1 FROM ch WHERE ch.entity = s.entity AND ch.scan = s.scan)",
        "SELECT s.entity, s.scan, 2, 0, 'App review sentiment: ' || coalesce(x.sentiment, 'neutral') || ' (severity ' || "
        f"CAST(coalesce(x.severity_score, {K.REVIEW_BASELINE}) AS VARCHAR) || '/10). Themes: ' || {themes} || '.' FROM scans s "
        "LEFT JOIN (SELECT entity, scan, arg_max(sentiment, id) AS sentiment, arg_max(severity_score, id) AS severity_score, "
        "arg_max(themes, id) AS themes FROM sn GROUP BY entity, scan) x ON x.entity = s.entity AND x.scan = s.scan",
        "SELECT entity, scan, 3, r, '  - (relevance ' || CAST(relevance AS VARCHAR) || '/10) ' || headline || ' - ' || summary FROM "
        "(SELECT *, row_number() OVER (PARTITION BY entity, scan ORDER BY relevance DESC, id ASC) AS r FROM nw) WHERE r <= 3",
        "SELECT DISTINCT entity, scan, 3, -1, 'Top news this scan:' FROM nw",
        "SELECT entity, scan, 3, -1, 'No news articles found this scan.' FROM scans s WHERE NOT EXISTS "
        "(SELECT 1 FROM nw WHERE nw.entity = s.entity AND nw.scan = s.scan)",
        "SELECT s.entity, s.scan, 4, 0, CASE WHEN x.campaign_focus IS NULL THEN 'No social channel signal available this scan.' ELSE "
        "'Social channel activity: ' || x.campaign_focus || ' focus, tone ' || lower(x.tone_shift) || '. ' || x.messaging_theme END "
        "FROM scans s LEFT JOIN (SELECT entity, scan, arg_max(campaign_focus, id) AS campaign_focus, arg_max(tone_shift, id) AS tone_shift, "
        "arg_max(messaging_theme, id) AS messaging_theme FROM so GROUP BY entity, scan) x ON x.entity = s.entity AND x.scan = s.scan",
        "SELECT entity, scan, 5, id, '  - (' || offer_type || ', ' || aggressiveness || ' aggressiveness) ' || description FROM of",
        "SELECT DISTINCT entity, scan, 5, -1, 'Offers/promotions detected this scan:' FROM of",
        "SELECT entity, scan, 5, -1, 'No new offers or promotions detected this scan.' FROM scans s WHERE NOT EXISTS "
        "(SELECT 1 FROM of WHERE of.entity = s.entity AND of.scan = s.scan)",
    ]
    return B.with_ctes(" UNION ALL ".join(parts), list(_SCAN_CTES), _SCAN_CTES)


@query("e8_signals_summary", _signals_sql())
def e8_signals_summary(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return M.signals_summary(i["scans"], i["changes"], i["sentiment"], i["news"], i["social"], i["offers"]).select(
        "entity", "scan", "section", "pos", "line")


def _context_sql() -> str:
    themes = "CASE WHEN len(coalesce(x.themes, [])) > 0 THEN array_to_string(x.themes, ', ') ELSE 'none' END"
    sent = ("SELECT b.*, x.sentiment, x.severity_score, x.themes, x.opportunity FROM base b LEFT JOIN (SELECT entity, scan, "
            "arg_max(sentiment, id) AS sentiment, arg_max(severity_score, id) AS severity_score, arg_max(themes, id) AS themes, "
            "arg_max(opportunity, id) AS opportunity FROM sn GROUP BY entity, scan) x ON x.entity = b.entity AND x.scan = b.scan")
    parts = [
        "SELECT scan, entity_pos, entity, 0 AS section, 0 AS pos, '## ' || entity AS line FROM base",
        "SELECT b.scan, b.entity_pos, b.entity, 1, c.id, '- Website (' || c.change_type || '): ' || c.description "
        "FROM ch c JOIN base b ON b.entity = c.entity AND b.scan = c.scan",
        "SELECT scan, entity_pos, entity, 2, 0, '- App review sentiment: ' || coalesce(sentiment, 'neutral') || ' (severity ' || "
        f"CAST(coalesce(severity_score, {K.REVIEW_BASELINE}) AS VARCHAR) || '/10), themes: ' || "
        f"{themes.replace('x.', '')} FROM sent",
        "SELECT scan, entity_pos, entity, 2, 1, '  Opportunity: ' || opportunity FROM sent WHERE coalesce(opportunity, '') <> ''",
        "SELECT b.scan, b.entity_pos, b.entity, 3, n.r, '- News: ' || n.headline || ' (' || n.impact_type || ', relevance ' || "
        "CAST(n.relevance AS VARCHAR) || '/10)' FROM (SELECT *, row_number() OVER (PARTITION BY entity, scan ORDER BY relevance DESC, "
        "id ASC) AS r FROM nw) n JOIN base b ON b.entity = n.entity AND b.scan = n.scan WHERE n.r <= 2",
        "SELECT b.scan, b.entity_pos, b.entity, 4, 0, '- Current threat score: ' || CAST(s.threat_score AS VARCHAR) || '/10' "
        "FROM base b LEFT JOIN (SELECT entity, CAST(scanned_at AS DATE) AS scan, threat_score FROM b_scores) s "
        "ON s.entity = b.entity AND s.scan = b.scan",
    ]
    extra = dict(_SCAN_CTES)
    extra["base"] = ("SELECT s.entity, s.scan, r.pos AS entity_pos FROM scans s JOIN b_roster r ON r.entity = s.entity",
                     ["scans", "b_roster"])
    extra["sent"] = (sent, ["base", "sn"])
    return B.with_ctes(" UNION ALL ".join(parts), ["base", "ch", "nw", "sent", "b_scores"], extra)


@query("e9_comparison_context", _context_sql())
def e9_comparison_context(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return M.comparison_context(i["scans"], T.roster(spark), i["changes"], i["sentiment"], i["news"], i["scores"])


@query("e10_scan_summary", B.with_ctes(
    "SELECT s.scan, s.n AS entities_scanned, coalesce(c.n, 0) AS changes_found, coalesce(w.n, 0) AS news_found, "
    "coalesce(e.n, 0) AS errors_found, coalesce(e.errs, []) AS errors FROM (SELECT scan, count(DISTINCT entity) AS n FROM scans GROUP BY scan) s "
    "LEFT JOIN (SELECT scan, count(*) AS n FROM ch GROUP BY scan) c ON c.scan = s.scan "
    "LEFT JOIN (SELECT scan, count(*) AS n FROM nw GROUP BY scan) w ON w.scan = s.scan "
    "LEFT JOIN (SELECT CAST(ts AS DATE) AS scan, count(*) AS n, list('E' || CAST(user_id % 8 AS VARCHAR) || ': scan failed (' || "
    "CAST(event_id AS VARCHAR) || ')' ORDER BY event_id) AS errs FROM events WHERE event_type = 'error' GROUP BY 1) e ON e.scan = s.scan",
    ["scans", "ch", "nw"], _SCAN_CTES))
def e10_scan_summary(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    ev = T.Raw(spark, sf_dir).table("events")
    errs = ev.filter(F.col("event_type") == "error").select(
        F.to_date("ts").alias("scan"), F.col("event_id").alias("seq"),
        F.concat(F.lit("E"), (F.col("user_id") % 8).cast("string"), F.lit(": scan failed ("),
                 F.col("event_id").cast("string"), F.lit(")")).alias("error"))
    return M.scan_summary(i["scans"], i["changes"], i["news"], errs)


def _brief_sql() -> str:
    from .q_reads import _fold_sql
    d = "(l.latest - l.previous)"
    trend = (f"CASE WHEN l.previous IS NULL THEN 'first scan' WHEN {d} > {K.TREND_EPSILON} THEN '+' || {B.fmt1(d)} "
             f"WHEN {d} < -{K.TREND_EPSILON} THEN {B.fmt1(d)} ELSE 'stable' END")
    marks = "CASE WHEN c.rating = 'green' THEN '(+)' WHEN c.rating = 'yellow' THEN '(~)' WHEN c.rating = 'red' THEN '(-)' ELSE '?' END"
    dims = ", ".join(f"({i}, {B.q(x)})" for i, x in enumerate(K.COMPARISON_DIMENSIONS))
    parts = [
        "SELECT 'scores' AS section, CAST(r.pos AS BIGINT) AS rank, r.entity, " + B.fmt1("l.latest") + " AS metric, "
        f"{trend} || ' | ' || {_fold_sql(f'substr(coalesce(l.reason, {chr(39)}{chr(39)}), 1, {K.BRIEF_REASON_CHARS})')} AS text "
        "FROM b_roster r JOIN lp l ON l.entity = r.entity",
        "SELECT 'changes', CAST(rk AS BIGINT), entity, CAST(customer_impact_score AS VARCHAR), "
        f"{_fold_sql(f'substr(coalesce(description, {chr(39)}{chr(39)}), 1, {K.BRIEF_CHANGE_CHARS})')} FROM (SELECT *, row_number() OVER "
        "(ORDER BY customer_impact_score DESC, detected_at DESC, id DESC) AS rk FROM (SELECT * FROM b_changes ORDER BY detected_at DESC, "
        f"id DESC LIMIT {K.CHANGES_VIEW_LIMIT}) WHERE customer_impact_score >= {K.IMPACT_GATE_MIN}) WHERE rk <= 5",
        "SELECT 'complaints', CAST(r.pos * 10 + x.i AS BIGINT), r.entity, CAST(NULL AS VARCHAR), "
        f"{_fold_sql(f'substr(x.c, 1, {K.BRIEF_COMPLAINT_CHARS})')} FROM b_roster r JOIN (SELECT entity, unnest(cs) AS c, "
        "generate_subscripts(cs, 1) - 1 AS i FROM (SELECT entity, arg_max(top_complaints, id)[1:2] AS cs FROM b_sentiment "
        "GROUP BY entity)) x ON x.entity = r.entity",
        "SELECT 'news', CAST(rk AS BIGINT), entity, CAST(relevance AS VARCHAR), "
        f"{_fold_sql(f'substr(headline, 1, {K.BRIEF_NEWS_CHARS})')} FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC, "
        f"fetched_at DESC, id DESC) AS rk FROM (SELECT * FROM b_news ORDER BY relevance DESC, fetched_at DESC, id DESC "
        f"LIMIT {K.NEWS_VIEW_LIMIT})) WHERE rk <= 5",
        f"SELECT 'matrix', CAST(d.dim_pos * 100 + r.pos AS BIGINT), c.entity, {marks}, "
        f"{_fold_sql(f'substr(concat_ws({chr(39)}: {chr(39)}, c.dimension, c.note), 1, {K.BRIEF_MATRIX_CHARS})')} "
        f"FROM cells c JOIN (VALUES {dims}) d(dim_pos, dimension) ON d.dimension = c.dimension JOIN b_roster r ON r.entity = c.entity",
    ]
    extra = {
        "lp": ("SELECT entity, max(CASE WHEN rn = 1 THEN threat_score END) AS latest, max(CASE WHEN rn = 2 THEN threat_score END) "
               "AS previous, max(CASE WHEN rn = 1 THEN reason END) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY entity "
               "ORDER BY id DESC) AS rn FROM b_scores) WHERE rn <= 2 GROUP BY entity", ["b_scores"]),
        "cells": ("SELECT entity, dimension, arg_max(rating, id) AS rating, arg_max(note, id) AS note FROM b_comparison "
                  "GROUP BY entity, dimension", ["b_comparison"]),
    }
    return B.with_ctes(" UNION ALL ".join(parts), ["b_roster", "lp", "b_changes", "b_sentiment", "b_news", "cells"], extra)


@query("g14_weekly_brief", _brief_sql())
def g14_weekly_brief(spark, sf_dir):
    raw = T.Raw(spark, sf_dir)
    cells = G.comparison_cells(T.comparison(raw))
    dims = T.literal_table(spark, [(i, d) for i, d in enumerate(K.COMPARISON_DIMENSIONS)], "dim_pos int, dimension string")
    return M.weekly_brief(T.roster(spark), T.scores(raw), T.changes(raw, with_text=False), T.sentiment(raw), T.news(raw),
                          cells, dims, describe=lambda df: T.describe(raw, df))
