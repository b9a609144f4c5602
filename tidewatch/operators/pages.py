"""Page extraction from parsed pages, canonical page text, hashing and change detection.

Everything after the single parse (B1) is native. A page's elements stand in its row, so sections are expressions over
that row (filters, first occurrences, slices): extraction and the canonical text need no shuffle at all.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import scalars as S


def _texts(elements: Column) -> Column:
    """Clean texts of elements, in their order."""
    return F.transform(elements, lambda e: S.clean_text(F.substring(F.col("text"), e["start"] + 1, e["stop"] - e["start"])))


def _tagged(tags: list[str]) -> Column:
    return F.filter("elements", lambda e: e["tag"].isin(*tags))


def _sized(texts: Column, least: int, most: int | None = None) -> Column:
    return F.filter(texts, lambda t: (F.length(t) >= least) & (F.length(t) <= most if most is not None else F.lit(True)))


def title_of() -> Column:
    """Title string, cleaned ('' when absent)."""
    return S.clean_text(F.col("title"))


def headings_of() -> Column:
    """All h1, then all h2, then all h3; non-empty; first occurrence kept."""
    return F.array_distinct(_sized(F.concat(*[_texts(_tagged([t])) for t in K.HEADING_TAGS]), 1))


def pricing_of() -> Column:
    """div/span/p/td/li/h1-h4 in document order, 1-200 chars, containing a pricing keyword; first occurrence."""
    def hit(t):
        low, found = F.lower(t), F.lit(False)
        for kw in K.PRICING_KEYWORDS:
            found = found | low.contains(kw.lower())
        return found

    return F.array_distinct(F.filter(_sized(_texts(_tagged(K.PRICING_TAGS)), 1, K.PRICING_TEXT_MAX), hit))


def features_of() -> Column:
    """Li text of 3-200 characters, distinct in first-seen order."""
    return F.array_distinct(_sized(_texts(_tagged(["li"])), K.FEATURE_TEXT_MIN, K.FEATURE_TEXT_MAX))


def article_titles_of() -> Column:
    """Per <article> (document order) the first existing h1, else h2, h3, h4 inside it - the first tag that exists
    wins even when its text is empty or already seen; then every element with a class matching /title|headline/i
    of 3-200 chars. One shared seen-set, articles first."""
    heads = _tagged(K.ARTICLE_TITLE_TAGS)

    def first(article):
        inside = F.filter(heads, lambda e: (e["ord"] > article["ord"]) & (e["ord"] <= article["until"]))
        ranked = F.transform(inside, lambda e: F.struct(
            F.array_position(F.array(*map(F.lit, K.ARTICLE_TITLE_TAGS)), e["tag"]).alias("rank"), e["ord"].alias("ord"),
            e["start"].alias("start"), e["stop"].alias("stop")))
        return F.array_min(ranked)

    firsts = F.filter(F.transform(_tagged(["article"]), first), lambda e: e.isNotNull())
    classed = F.filter("elements", lambda e: F.exists(e["classes"], lambda c: c.rlike(K.TITLE_CLASS_PATTERN)))
    return F.array_distinct(F.concat(_sized(_texts(firsts), 1), _sized(_texts(classed), K.FEATURE_TEXT_MIN, K.PRICING_TEXT_MAX)))


def paragraphs_of() -> Column:
    """Only the first 180 <p>; keep texts of 20+ characters; stop at 60; no de-duplication."""
    return F.slice(_sized(_texts(F.slice(_tagged(["p"]), 1, K.PARAGRAPH_SCAN_LIMIT)), K.PARAGRAPH_MIN_CHARS), 1, K.PARAGRAPH_KEEP)


def _rows(parsed: DataFrame, texts: Column) -> DataFrame:
    """(page_id, pos, text): a section's entries in order."""
    return parsed.select("page_id", F.posexplode(texts).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


def headings(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, headings_of())


def pricing_snippets(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, pricing_of())


def feature_bullets(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, features_of())


def article_titles(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, article_titles_of())


def body_paragraphs(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, paragraphs_of())


def page_text_of(profile: str = "page") -> Column:
    """Canonical text: '## NAME' headers always present, the title line only when non-empty, parts in their own
    order, newline-joined."""
    parts = {"TITLE": F.when(title_of() != "", F.array(title_of())).otherwise(F.array().cast("array<string>")), "HEADINGS": headings_of()}
    if profile == "page":
        parts |= {"PRICING": pricing_of(), "FEATURES": features_of()}
    else:
        parts |= {"ARTICLE TITLES": article_titles_of(), "BODY TEXT": paragraphs_of()}
    return F.array_join(F.concat(*[x for name, part in parts.items() for x in (F.array(F.lit(f"## {name}")), part)]), "\n")


def page_text(parsed: DataFrame, profile: str = "page") -> DataFrame:
    """B8 per page."""
    return parsed.select("page_id", page_text_of(profile).alias("content_text"))


def with_hash(df: DataFrame, text_col: str = "content_text") -> DataFrame:
    """B9."""
    return df.withColumn("content_hash", S.content_hash(F.col(text_col)))


def compare_snapshots(current: DataFrame, snapshots: DataFrame, keys=("entity", "page_key")) -> DataFrame:
    """Baseline (no snapshot), unchanged (equal hash) or changed, with the previous text."""
    prev = snapshots.select(*keys, F.col("content_hash").alias("prev_hash"), F.col("content_text").alias("prev_text"))
    j = current.join(prev, list(keys), "left")
    status = (F.when(F.col("prev_hash").isNull(), "baseline")
              .when(F.col("prev_hash") == F.col("content_hash"), "unchanged").otherwise("changed"))
    return j.withColumn("status", status)


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Difflib unified diff (3 context lines, headers previous/current), newline-joined."""
    out = []
    for a, b in zip(old, new):
        lines = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="",
                                     fromfile="previous", tofile="current")
        out.append("\n".join(lines))
    return pd.Series(out, dtype="object")


def line_diff(compared: DataFrame) -> DataFrame:
    """B11 on `changed` rows only (the hash filter runs before the Arrow step)."""
    return compared.filter(F.col("status") == "changed").withColumn(
        "diff", unified_diff(F.col("prev_text"), F.col("content_text")))


def _lines(text: Column) -> Column:
    """Lines as str.splitlines() cuts them for the usual separators (\\r\\n, \\n, \\r)."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(F.regexp_replace(t, "\\r\\n|\\r|\\u2028|\\u2029|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e|\\x85", "\n"), "\n")
    # splitlines drops the empty string after a final line break
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.when(F.right(F.regexp_replace(t, "\\r\\n|\\r|\\u2028|\\u2029|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e|\\x85", "\n"), F.lit(1)) == "\n",
               F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def diff_profile(compared: DataFrame, keys=("entity", "page_key")) -> DataFrame:
    """Lines added and removed between previous and current text, as a multiset difference: one aggregate over the
    lines of both sides."""
    keys = list(keys)
    sides = F.array(F.struct(F.lit(1).alias("side"), _lines(F.col("content_text")).alias("lines")),
                    F.struct(F.lit(-1).alias("side"), _lines(F.col("prev_text")).alias("lines")))
    rows = compared.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", F.explode_outer("s.lines").alias("line"))
    balance = rows.groupBy(*keys, "line").agg(F.sum(F.when(F.col("line").isNotNull(), F.col("side")).otherwise(0)).alias("n"))
    return balance.groupBy(*keys).agg(
        F.sum(F.greatest("n", F.lit(0))).cast("long").alias("lines_added"),
        F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("long").alias("lines_removed"))


def impact_gate(df: DataFrame, minimum: int = K.IMPACT_GATE_MIN) -> DataFrame:
    """Classified changes below the minimum impact are dropped (the snapshot still advances)."""
    return df.filter(F.col("customer_impact_score") >= minimum)


def route_changes(df: DataFrame) -> dict[str, DataFrame]:
    """Page layer -> changes; update layer -> changes (page_type product_updates) and product
    mapping; offer layer -> offers only (never feature velocity)."""
    return {
        "changes": df.filter(F.col("layer").isin("page", "update")).withColumn(
            "page_type", F.when(F.col("layer") == "update", F.lit("product_updates")).otherwise(F.col("page_type"))),
        "products": df.filter(F.col("layer") == "update"),
        "offers": df.filter(F.col("layer") == "offer"),
    }
