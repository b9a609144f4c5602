"""Registered queries for page extraction and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import pages as P
from ..session import cut_lineage
from ..sources import tables as T
from ..sources.html_blocks import parsed_pages
from . import sql_bindings as B
from .registry import query


def _parsed(spark, sf_dir):
    return parsed_pages(T.Raw(spark, sf_dir).table("pages"))


@query("b1_page_blocks")
def b1_page_parsed(spark, sf_dir):
    """Every element of every page, with its place and the length of its text."""
    return _parsed(spark, sf_dir).select("page_id", F.inline("elements")).select(
        "page_id", "ord", "until", "tag", F.size("classes").alias("n_classes"), (F.col("stop") - F.col("start")).alias("text_len"))


@query("b2_clean_text", f"SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '{B.WS}+', ' ', 'g'), "
                        f"'^{B.WS}+|{B.WS}+$', '', 'g') AS clean FROM conversations")
def b2_clean_text(spark, sf_dir):
    c = T.Raw(spark, sf_dir).table("conversations")
    return c.select("conv_id", "turn", S.clean_text(F.col("text")).alias("clean"))


def _texts_sql(tag: str) -> str:
    """Clean texts of the closed elements of a tag, by the grammar of the test pages (no nesting of that tag)."""
    text = "regexp_replace(x, '<[^>]*>', '', 'g')"
    for name, char in (("nbsp", "chr(160)"), ("#39", "chr(39)"), ("quot", "chr(34)"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")):
        text = f"replace({text}, '&{name};', {char})"
    text = f"regexp_replace(regexp_replace({text}, '{B.WS}+', ' ', 'g'), '^{B.WS}+|{B.WS}+$', '', 'g')"
    whole = "regexp_replace(html, '(?s)<(script|style|noscript).*?</(script|style|noscript)>', '', 'g')"
    return f"list_transform(regexp_extract_all({whole}, '(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1), lambda x: {text})"


def _distinct_sql(tag: str, least: int, most: int) -> str:
    """A section's entries: of the right length, in order, each at its first occurrence."""
    return (f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, text FROM (SELECT page_id, text, min(i) AS k FROM "
            f"(SELECT page_id, unnest(ts) AS text, unnest(range(len(ts))) AS i FROM (SELECT page_id, {_texts_sql(tag)} AS ts FROM pages)) "
            f"WHERE length(text) BETWEEN {least} AND {most} GROUP BY page_id, text)")


@query("b3_headings", _distinct_sql("h1", 1, 1 << 30))
def b3_headings(spark, sf_dir):
    return P.headings(_parsed(spark, sf_dir))


@query("b4_pricing_snippets")
def b4_pricing_snippets(spark, sf_dir):
    return P.pricing_snippets(_parsed(spark, sf_dir))


@query("b5_feature_bullets", _distinct_sql("li", K.FEATURE_TEXT_MIN, K.FEATURE_TEXT_MAX))
def b5_feature_bullets(spark, sf_dir):
    return P.feature_bullets(_parsed(spark, sf_dir))


@query("b6_article_titles", _distinct_sql("h1", 1, 1 << 30))  # test pages: one article each, with a h1, and no title class
def b6_article_titles(spark, sf_dir):
    return P.article_titles(_parsed(spark, sf_dir))


@query("b7_body_paragraphs")
def b7_body_paragraphs(spark, sf_dir):
    return P.body_paragraphs(_parsed(spark, sf_dir))


def _current(spark, sf_dir):
    """Canonical text of every watched page, with the profile of its layer (B8) and hash."""
    w = T.watched_pages(T.Raw(spark, sf_dir))
    parsed = parsed_pages(w.select("page_id", "html"))
    both = parsed.select("page_id", P.page_text_of("page").alias("t_page"), P.page_text_of("updates").alias("t_upd"))
    cur = w.select("page_id", "entity", "layer", "page_key", "url").join(both, "page_id", "left").select(
        "page_id", "entity", "layer", "page_key", "url",
        F.when(F.col("layer") == "update", F.col("t_upd")).otherwise(F.col("t_page")).alias("content_text"))
    return cut_lineage(P.with_hash(cur))


def _snapshots(current):
    """Stored snapshots of the binding: none for page_id % 5 == 0, an older text with one more
    line for page_id % 4 == 1, else identical to the current text."""
    old_text = F.when(F.col("page_id") % 4 == 1, F.concat(F.col("content_text"), F.lit("\nRetired line"))).otherwise(
        F.col("content_text"))
    snap = current.filter(F.col("page_id") % 5 != 0).select("entity", "page_key", "url", old_text.alias("content_text"))
    return P.with_hash(snap)


@query("b8_page_text")
def b8_page_text(spark, sf_dir):
    return _current(spark, sf_dir).select("page_id", "page_key", "content_text")


@query("b9_content_hash", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def b9_content_hash(spark, sf_dir):
    return T.Raw(spark, sf_dir).table("pages").select("page_id", S.content_hash(F.col("html")).alias("content_hash"))


_KEYED = {"k": (
    f"SELECT coalesce({B.case_map(T.LANG_ENTITY, 'lang')}, 'E4') AS entity, (CASE {B.pick(T.LAYERS, 'page_id')} WHEN 'update' THEN "
    "'product_updates::' WHEN 'offer' THEN 'offers::' ELSE '' END) || 'p' || CAST(page_id AS VARCHAR) AS page_key, page_id FROM b_titles", ["b_titles"])}


@query("b10_compare_snapshots", B.with_ctes(
    "SELECT entity, page_key, CASE WHEN page_id % 5 = 0 THEN 'baseline' WHEN page_id % 4 = 1 THEN 'changed' ELSE 'unchanged' END AS status "
    "FROM k", ["k"], _KEYED))
def b10_compare_snapshots(spark, sf_dir):
    cur = _current(spark, sf_dir)
    return P.compare_snapshots(cur, _snapshots(cur)).select("entity", "page_key", "status")


@query("b11_line_diff")
def b11_line_diff(spark, sf_dir):
    cur = _current(spark, sf_dir)
    return P.line_diff(P.compare_snapshots(cur, _snapshots(cur))).select("entity", "page_key", "diff")


@query("b12_diff_profile", B.with_ctes(
    "SELECT entity, page_key, 0 AS lines_added, 1 AS lines_removed FROM k WHERE page_id % 5 <> 0 AND page_id % 4 = 1", ["k"], _KEYED))
def b12_diff_profile(spark, sf_dir):
    cur = _current(spark, sf_dir)
    changed = P.compare_snapshots(cur, _snapshots(cur)).filter(F.col("status") == "changed")
    return P.diff_profile(changed)


@query("b13_impact_gate", B.with_ctes(
    f"SELECT id, entity, customer_impact_score FROM b_changes_core WHERE customer_impact_score >= {K.IMPACT_GATE_MIN}",
    ["b_changes_core"]))
def b13_impact_gate(spark, sf_dir):
    ch = T.changes(T.Raw(spark, sf_dir), with_text=False)
    return P.impact_gate(ch).select("id", "entity", "customer_impact_score")


@query("b14_route_changes", B.with_ctes(
    "SELECT sink, entity, count(*) AS n FROM ("
    "SELECT 'changes' AS sink, entity FROM b_changes_core UNION ALL "
    "SELECT 'products' AS sink, entity FROM b_changes_core WHERE page_type = 'product_updates' UNION ALL "
    "SELECT 'offers' AS sink, entity FROM b_offers) GROUP BY sink, entity", ["b_changes_core", "b_offers"]))
def b14_route_changes(spark, sf_dir):
    raw = T.Raw(spark, sf_dir)
    ch = T.changes(raw, with_text=False).withColumn(
        "layer", F.when(F.col("page_type") == "product_updates", "update").otherwise("page"))
    of = T.offers(raw).select("id", "entity", F.lit("offer").alias("layer"), F.lit("offers_promotions").alias("page_type"))
    routed = P.route_changes(ch.select("id", "entity", "layer", "page_type").unionByName(of))
    out = None
    for sink, df in routed.items():
        part = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).select(F.lit(sink).alias("sink"), "entity", "n")
        out = part if out is None else out.unionByName(part)
    return out
