"""Registered queries for text similarity and de-duplication (C1-C13, G3/G4 with their folds)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import similarity as C
from ..operators import views as G
from ..sources import tables as T
from . import sql_bindings as B
from .registry import query


def _news(spark, sf_dir):
    return T.news(T.Raw(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- C1 / C2
@query("c1_normalize_headline", B.with_ctes(
    f"SELECT id, {B.normalize_headline('headline')} AS norm FROM b_news", ["b_news"]))
def c1_normalize_headline(spark, sf_dir):
    return _news(spark, sf_dir).select("id", S.normalize_headline(F.col("headline")).alias("norm"))


_STOP = B.sql_list(K.STOPWORDS)
_TOKENS_CTE = {"toks": (
    f"SELECT id, entity, tok FROM (SELECT id, entity, unnest(regexp_extract_all(lower({B.normalize_headline('headline')}), "
    f"'[a-z0-9]+')) AS tok FROM b_news) WHERE length(tok) > 2 AND NOT list_contains({_STOP}, tok)", ["b_news"])}


@query("c2_token_counts", B.with_ctes("SELECT id, tok AS token, count(*) AS tf FROM toks GROUP BY id, tok",
                                      ["toks"], _TOKENS_CTE))
def c2_token_counts(spark, sf_dir):
    n = _news(spark, sf_dir).select("id", S.tokens(S.normalize_headline(F.col("headline"))).alias("t"))
    return n.select("id", F.explode("t").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


# ---------------------------------------------------------------------------------------------- C3
def _cosine_sql(threshold: float) -> str:
    extra = dict(_TOKENS_CTE)
    extra["tf"] = ("SELECT id, entity, tok, count(*) AS tf FROM toks GROUP BY id, entity, tok", ["toks"])
    extra["nrm"] = ("SELECT id, sum(tf * tf) AS n2 FROM tf GROUP BY id", ["tf"])
    extra["dots"] = ("SELECT x.id AS a, y.id AS b, x.entity AS block, sum(x.tf * y.tf) AS dot FROM tf x JOIN tf y "
                     "ON x.entity = y.entity AND x.tok = y.tok AND x.id > y.id GROUP BY x.id, y.id, x.entity", ["tf"])
    sql = ("SELECT a, b, block, cosine FROM (SELECT d.a, d.b, d.block, CAST(d.dot AS DOUBLE) / (sqrt(CAST(na.n2 AS DOUBLE)) "
           "* sqrt(CAST(nb.n2 AS DOUBLE))) AS cosine FROM dots d JOIN nrm na ON na.id = d.a JOIN nrm nb ON nb.id = d.b) "
           f"WHERE cosine >= {threshold}")
    return B.with_ctes(sql, ["dots", "nrm"], extra)


@query("c3_cosine_pairs", _cosine_sql(K.HEADLINE_COSINE_MIN))
def c3_cosine_pairs(spark, sf_dir):
    items = C.headline_items(_news(spark, sf_dir), F.col("id"))
    return C.cosine_pairs(items, K.HEADLINE_COSINE_MIN)


# ---------------------------------------------------------------------------------------------- C5 / C6 / C7 / C8
@query("c5_headline_matches")
def c5_headline_matches(spark, sf_dir):
    """Directed same-story matches of an entity's distinct headlines, by the smallest id of each."""
    items = C.headline_items(C.headlines(_news(spark, sf_dir)), F.col("id"))
    return C.matched_texts(items, K.HEADLINE_RATIO_MIN, K.HEADLINE_COSINE_MIN, strict=False)


@query("c5_headline_texts", B.with_ctes(
    f"SELECT id, entity, min(id) OVER w AS text_id, count(*) OVER w AS copies FROM (SELECT id, entity, "
    f"{B.normalize_headline('headline')} AS t FROM b_news) WINDOW w AS (PARTITION BY entity, t)", ["b_news"]))
def c5_headline_texts(spark, sf_dir):
    """Which rows a representative of c5_headline_matches stands for."""
    items = C.headline_items(_news(spark, sf_dir), F.col("id"))
    return C.named_texts(items).select(F.col("iid").alias("id"), "entity", "text_id", "copies")


@query("c6_group_stories")
def c6_group_stories(spark, sf_dir):
    n = _news(spark, sf_dir).select("id", "entity", "headline", "source", "relevance")
    return C.group_stories(n, F.col("id")).select("id", "entity", "group_id")


@query("c7_best_source")
def c7_best_source(spark, sf_dir):
    n = _news(spark, sf_dir).select("id", "entity", "headline", "source", "relevance")
    return C.dedupe_stories(n, F.col("id")).select("id", "entity", "group_id", "source")


@query("c8_cap_stories")
def c8_cap_stories(spark, sf_dir):
    n = _news(spark, sf_dir).select("id", "entity", "headline", "source", "relevance")
    return C.cap_stories(C.dedupe_stories(n, F.col("id")), K.NEWS_KEPT_PER_SCAN).select(
        "id", "entity", "group_id", "relevance")


# ---------------------------------------------------------------------------------------------- C9
@query("c9_drop_covered")
def c9_drop_covered(spark, sf_dir):
    """Every stored headline checked as a candidate against its entity's recent stored set."""
    n = _news(spark, sf_dir)
    return C.drop_covered(n.select("id", "entity", "headline"), n, T.as_of()).select("id", "entity")


# ---------------------------------------------------------------------------------------------- C10 / C11
@query("c10_description_matches")
def c10_description_matches(spark, sf_dir):
    """Directed near-duplicate matches of an entity's distinct descriptions that come near each other in time."""
    ch = T.changes(T.Raw(spark, sf_dir)).select("id", "entity", "detected_at", "description")
    return C.matched_texts(C.description_items(ch, F.col("id")), K.DESCRIPTION_RATIO_MIN, K.DESCRIPTION_COSINE_MIN,
                           strict=True, window_days=K.DESCRIPTION_WINDOW_DAYS)


@query("c10_description_texts", B.with_ctes(
    "SELECT id, entity, min(id) OVER w AS text_id, count(*) OVER w AS copies FROM b_changes "
    "WINDOW w AS (PARTITION BY entity, coalesce(description, ''))", ["b_changes"]))
def c10_description_texts(spark, sf_dir):
    """Which rows a representative of c10_description_matches stands for."""
    ch = T.changes(T.Raw(spark, sf_dir)).select("id", "entity", "detected_at", "description")
    return C.named_texts(C.description_items(ch, F.col("id"))).select(F.col("iid").alias("id"), "entity", "text_id", "copies")


@query("c11_dedupe_changes")
def c11_dedupe_changes(spark, sf_dir):
    ch = T.changes(T.Raw(spark, sf_dir)).select("id", "entity", "detected_at", "description", "customer_impact_score")
    return C.dedupe_changes(ch).select("id", "entity", "slot_key", "customer_impact_score")


@query("g3_changes_view")
def g3_changes_view(spark, sf_dir):
    raw = T.Raw(spark, sf_dir)
    # the fold compares descriptions, so they are attached after the newest-500 read, before C11
    out = G.changes_view(T.changes(raw, with_text=False), T.as_of(), segment="SMB",
                         dedupe=lambda top: C.dedupe_changes(T.describe(raw, top)))
    return out.select("id", "entity", "slot_key", "customer_impact_score", "segment_affected")


@query("g4_news_view")
def g4_news_view(spark, sf_dir):
    n = _news(spark, sf_dir)

    def dedupe(df):
        # the read order (relevance desc, fetched_at desc, id desc) is the input order of the fold
        rank = F.row_number().over(
            Window.partitionBy("entity").orderBy(
                F.col("relevance").desc(), F.col("fetched_at").desc(), F.col("id").desc()))
        return C.dedupe_stories(df, rank)

    out = G.news_view(n, T.as_of(), level="High", dedupe=dedupe)
    return out.select("id", "entity", "group_id", "relevance", "source")


# ---------------------------------------------------------------------------------------------- C12 / C13
@query("c12_c13_source_rank", B.with_ctes(
    f"SELECT id, source, {B.source_weight('source')} AS weight, {B.source_rank('source')} AS credibility_rank FROM b_news",
    ["b_news"]))
def c12_c13_source_rank(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("id", "source", S.source_weight(F.col("source")).alias("weight"),
                    S.source_rank(F.col("source")).alias("credibility_rank"))


@query("c4_seq_ratio")
def c4_seq_ratio(spark, sf_dir):
    """Ratcliff-Obershelp ratio in both argument orders for every same-story pair of distinct headlines."""
    n = C.headlines(_news(spark, sf_dir))
    pairs = C.matched_texts(C.headline_items(n, F.col("id")), K.HEADLINE_RATIO_MIN, K.HEADLINE_COSINE_MIN, strict=False)
    return C.ratios_of_pairs(pairs, n.select("id", S.normalize_headline(F.col("headline")).alias("text")))
