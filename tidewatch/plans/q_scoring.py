"""Registered queries for the scoring operators (E1-E7, E11) and the latest-row reads they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import scoring as E
from ..sources import tables as T
from . import sql_bindings as B
from .registry import query

_W = K.SIGNAL_WEIGHTS
_AGG = B.case_map(K.AGGRESSIVENESS_SCORES, "aggressiveness", K.UNKNOWN_LABEL_SCORE)

_COMPONENT_CTES = {
    "c_news": ("SELECT entity, sum(relevance) / count(relevance) AS news_value FROM b_news GROUP BY entity", ["b_news"]),
    "c_velocity": ("SELECT entity, sum(customer_impact_score) / count(customer_impact_score) AS velocity_value "
                   "FROM b_changes_core GROUP BY entity", ["b_changes_core"]),
    "c_social": (f"SELECT entity, {B.social_score('arg_max(tone_shift, id)', 'arg_max(campaign_focus, id)')} AS social_value "
                 "FROM b_social GROUP BY entity", ["b_social"]),
    "c_offers_top": ("SELECT * FROM (SELECT entity, id, detected_at, aggressiveness, row_number() OVER "
                     "(PARTITION BY entity ORDER BY detected_at DESC, id DESC) AS rn FROM b_offers) WHERE rn <= 10",
                     ["b_offers"]),
    "c_offers": (f"SELECT entity, sum({_AGG}) / count(*) AS offers_value FROM c_offers_top GROUP BY entity",
                 ["c_offers_top"]),
    "c_review": ("SELECT entity, arg_max(severity_score, id) AS review_value FROM b_sentiment GROUP BY entity",
                 ["b_sentiment"]),
}


def _components(spark, sf_dir):
    raw = T.Raw(spark, sf_dir)
    return dict(
        roster=T.roster(spark),
        review=E.review_component(T.sentiment(raw)),
        news=E.news_component(T.news(raw)),
        velocity=E.velocity_component(T.changes(raw, with_text=False)),
        social=E.social_component(None, T.social(raw)),
        offers=E.offers_component(T.offers(raw)),
    )


def _composite_sql() -> str:
    rv = f"coalesce(CAST(rc.review_value AS DOUBLE), {K.REVIEW_BASELINE})"
    nv = f"coalesce(CAST(nc.news_value AS DOUBLE), {K.NEWS_BASELINE})"
    vv = f"coalesce(CAST(vc.velocity_value AS DOUBLE), {K.VELOCITY_BASELINE})"
    sv = f"CAST(coalesce(r.static_weight, {K.STATIC_DEFAULT}) AS DOUBLE)"
    so = f"coalesce(CAST(sc.social_value AS DOUBLE), {K.SOCIAL_BASELINE})"
    of = f"coalesce(CAST(oc.offers_value AS DOUBLE), {K.OFFERS_BASELINE})"
    total = (f"({_W['review']} * {rv} + {_W['news']} * {nv} + {_W['velocity']} * {vv} + "
             f"{_W['static']} * {sv} + {_W['social']} * {so} + {_W['offers']} * {of})")
    sql = (f"SELECT r.pos, r.entity, {B.round1(B.clamp(total, 1.0, 10.0))} AS threat_score, "
           f"{B.round1(rv)} AS review_component, {B.round1(nv)} AS news_component, "
           f"{B.round1(vv)} AS feature_velocity_component, {sv} AS smb_relevance_component, "
           f"{B.round1(so)} AS social_component, {B.round1(of)} AS offers_component "
           "FROM b_roster r LEFT JOIN c_review rc ON rc.entity = r.entity LEFT JOIN c_news nc ON nc.entity = r.entity "
           "LEFT JOIN c_velocity vc ON vc.entity = r.entity LEFT JOIN c_social sc ON sc.entity = r.entity "
           "LEFT JOIN c_offers oc ON oc.entity = r.entity")
    return B.with_ctes(sql, ["b_roster", "c_review", "c_news", "c_velocity", "c_social", "c_offers"], _COMPONENT_CTES)


@query("e6_composite_score", _composite_sql())
def e6_composite_score(spark, sf_dir):
    c = _components(spark, sf_dir)
    return E.composite_score(c["roster"], c["review"], c["news"], c["velocity"], c["social"], c["offers"])


@query("e1_news_component", B.with_ctes("SELECT * FROM c_news", ["c_news"], _COMPONENT_CTES))
def e1_news_component(spark, sf_dir):
    return E.news_component(T.news(T.Raw(spark, sf_dir)))


@query("e2_velocity_component", B.with_ctes("SELECT * FROM c_velocity", ["c_velocity"], _COMPONENT_CTES))
def e2_velocity_component(spark, sf_dir):
    return E.velocity_component(T.changes(T.Raw(spark, sf_dir), with_text=False))


@query("e3_static_component", B.with_ctes(
    f"SELECT e.entity, CAST(coalesce(r.static_weight, {K.STATIC_DEFAULT}) AS DOUBLE) AS static_value FROM "
    "(SELECT DISTINCT entity FROM (SELECT entity FROM b_changes_core UNION ALL SELECT 'N' || CAST(id % 3 AS VARCHAR) FROM b_news)) e "
    "LEFT JOIN b_roster r ON r.entity = e.entity", ["b_changes_core", "b_news", "b_roster"]))
def e3_static_component(spark, sf_dir):
    """Weights of the entities that own changes, and of three that no roster knows (named after news rows)."""
    raw = T.Raw(spark, sf_dir)
    new = T.news(raw).select(F.concat(F.lit("N"), (F.col("id") % 3).cast("string")).alias("entity"))
    seen = T.changes(raw, with_text=False).select("entity").union(new).distinct()
    return E.static_component(seen, T.roster(spark).select("entity", "static_weight"))


@query("e4_social_component", B.with_ctes("SELECT * FROM c_social", ["c_social"], _COMPONENT_CTES))
def e4_social_component(spark, sf_dir):
    return E.social_component(None, T.social(T.Raw(spark, sf_dir)))


@query("e5_offers_component", B.with_ctes("SELECT * FROM c_offers", ["c_offers"], _COMPONENT_CTES))
def e5_offers_component(spark, sf_dir):
    return E.offers_component(T.offers(T.Raw(spark, sf_dir)))


def _delta_sql() -> str:
    cur = "s1.threat_score"
    prev = "s2.threat_score"
    d = f"({cur} - {prev})"
    text = (f"CASE WHEN s2.threat_score IS NULL THEN printf('This is the first recorded threat score for %s: %s/10.', "
            f"r.entity, {B.fmt1(cur)}) ELSE printf('%s''s threat score moved from %s to %s (%s%s).', r.entity, "
            f"{B.fmt1(prev)}, {B.fmt1(cur)}, CASE WHEN {d} >= 0 THEN '+' ELSE '' END, {B.fmt1(d)}) END")
    sql = ("SELECT r.entity, s1.threat_score AS score, s2.threat_score AS prior_score, "
           f"CASE WHEN s1.threat_score IS NULL THEN NULL ELSE {text} END AS delta_text "
           "FROM b_roster r LEFT JOIN ranked s1 ON s1.entity = r.entity AND s1.rn = 1 "
           "LEFT JOIN ranked s2 ON s2.entity = r.entity AND s2.rn = 2")
    extra = {"ranked": ("SELECT entity, threat_score, row_number() OVER (PARTITION BY entity ORDER BY id DESC) AS rn "
                        "FROM b_scores", ["b_scores"])}
    return B.with_ctes(sql, ["b_roster", "ranked"], extra)


@query("e7_delta_text", _delta_sql())
def e7_delta_text(spark, sf_dir):
    from ..operators import reads as R
    raw = T.Raw(spark, sf_dir)
    sc = T.scores(raw)
    lp = R.latest_and_previous(sc.select("entity", "id", "threat_score"), "threat_score")
    j = T.roster(spark).select("entity").join(lp, "entity", "left")
    return j.select(
        "entity", F.col("latest").alias("score"), F.col("previous").alias("prior_score"),
        F.when(F.col("latest").isNull(), F.lit(None).cast("string")).otherwise(
            E.delta_text(F.col("entity"), F.col("previous"), F.col("latest"))).alias("delta_text"))


@query("e11_reason_or_default", B.with_ctes(
    f"SELECT id, entity, CASE WHEN coalesce(trim(reason), '') = '' OR reason LIKE '%explanation unavailable%' "
    f"THEN {B.q(K.REASON_FALLBACK)} ELSE reason END AS reason FROM b_scores", ["b_scores"]))
def e11_reason_or_default(spark, sf_dir):
    sc = T.scores(T.Raw(spark, sf_dir))
    # The binding plants the fallback sentence on some rows; those count as "no explanation".
    missing = F.col("reason").contains(K.UNAVAILABLE_MARKER)
    return sc.select("id", "entity", E.reason_or_default(F.when(missing, F.lit(None)).otherwise(F.col("reason"))).alias("reason"))


_SCAN_DAY = "2024-01-30 00:00:00"


@query("e4_social_component_scan", B.with_ctes(
    f"SELECT coalesce(n.entity, s.entity) AS entity, coalesce(n.v, s.v) AS social_value FROM "
    f"(SELECT entity, {B.social_score('arg_max(tone_shift, id)', 'arg_max(campaign_focus, id)')} AS v FROM b_social "
    f"WHERE scanned_at >= TIMESTAMP '{_SCAN_DAY}' GROUP BY entity) n FULL OUTER JOIN "
    f"(SELECT entity, {B.social_score('arg_max(tone_shift, id)', 'arg_max(campaign_focus, id)')} AS v FROM b_social "
    f"WHERE scanned_at < TIMESTAMP '{_SCAN_DAY}' GROUP BY entity) s ON n.entity = s.entity", ["b_social"]))
def e4_social_component_scan(spark, sf_dir):
    """This scan (the last day) first, else the latest stored row before it."""
    so = T.social(T.Raw(spark, sf_dir))
    day = F.lit(_SCAN_DAY).cast("timestamp")
    return E.social_component(so.filter(F.col("scanned_at") >= day), so.filter(F.col("scanned_at") < day))
