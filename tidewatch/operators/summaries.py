"""Per-scan signal summaries, the cross-entity context and the weekly brief.

The summaries are produced as tidy line rows (keys, section, pos, line) rather than one string per
entity: every line is computed where its data lives and nothing is collected into one task. A
caller that needs the text of one bounded group (one entity, one scan) joins its lines with
`assemble`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from . import reads as R
from .scoring import latest_by_id


def _num_text(c: Column) -> Column:
    """Python's str() of an int or of a one-decimal float."""
    return c.cast("string")


def assemble(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Join the lines of each (bounded) group in (section, pos) order with newlines."""
    agg = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("section", "pos", "line"))).alias("ls"))
    return agg.select(*keys, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def signals_summary(scans: DataFrame, changes: DataFrame, sentiment: DataFrame, news: DataFrame,
                    social: DataFrame, offers: DataFrame) -> DataFrame:
    """Summary lines per (entity, scan). All inputs carry `entity` and `scan`; scans lists the
    (entity, scan) pairs that were scanned."""
    keys = ["entity", "scan"]
    out = []
    # 1. website changes
    ch_lines = changes.select(*keys, F.lit(1).alias("section"), F.col("id").alias("pos"), F.format_string(
        "  - (%s, impact %s/10) %s", F.col("change_type"), _num_text(F.col("customer_impact_score")), F.col("description")).alias("line"))
    has_ch = changes.select(*keys).distinct()
    out.append(ch_lines)
    out.append(has_ch.select(*keys, F.lit(1).alias("section"), F.lit(-1).cast("long").alias("pos"),
                             F.lit("Website changes detected this scan:").alias("line")))
    out.append(scans.join(has_ch, keys, "left_anti").select(*keys, F.lit(1).alias("section"), F.lit(-1).cast("long").alias("pos"),
                                                            F.lit("No website changes detected this scan.").alias("line")))
    # 2. review sentiment (latest analysis of the scan, neutral default)
    sent = latest_by_id(sentiment.select(F.struct(*keys).alias("k"), "id", "sentiment", "severity_score", "themes"), "k")
    sent = scans.join(sent.select("k.*", "sentiment", "severity_score", "themes"), keys, "left")
    themes = F.when(F.size(F.coalesce("themes", F.array())) > 0, F.array_join("themes", ", ")).otherwise(F.lit("none"))
    out.append(sent.select(*keys, F.lit(2).alias("section"), F.lit(0).cast("long").alias("pos"), F.format_string(
        "App review sentiment: %s (severity %s/10). Themes: %s.", F.coalesce("sentiment", F.lit("neutral")),
        _num_text(F.coalesce(F.col("severity_score"), F.lit(K.REVIEW_BASELINE))), themes).alias("line")))
    # 3. top-3 news by relevance (stable)
    w = Window.partitionBy(*keys).orderBy(F.col("relevance").desc(), F.col("id").asc())
    top = news.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 3)
    out.append(top.select(*keys, F.lit(3).alias("section"), F.col("_r").cast("long").alias("pos"), F.format_string(
        "  - (relevance %s/10) %s - %s", _num_text(F.col("relevance")), F.col("headline"), F.col("summary")).alias("line")))
    has_news = news.select(*keys).distinct()
    out.append(has_news.select(*keys, F.lit(3).alias("section"), F.lit(-1).cast("long").alias("pos"), F.lit("Top news this scan:").alias("line")))
    out.append(scans.join(has_news, keys, "left_anti").select(*keys, F.lit(3).alias("section"), F.lit(-1).cast("long").alias("pos"),
                                                              F.lit("No news articles found this scan.").alias("line")))
    # 4. social (this scan's latest row)
    soc = latest_by_id(social.select(F.struct(*keys).alias("k"), "id", "campaign_focus", "tone_shift", "messaging_theme"), "k")
    soc = scans.join(soc.select("k.*", "campaign_focus", "tone_shift", "messaging_theme"), keys, "left")
    out.append(soc.select(*keys, F.lit(4).alias("section"), F.lit(0).cast("long").alias("pos"), F.when(
        F.col("campaign_focus").isNull(), F.lit("No social channel signal available this scan.")).otherwise(F.format_string(
            "Social channel activity: %s focus, tone %s. %s", F.col("campaign_focus"), F.lower("tone_shift"),
            F.col("messaging_theme"))).alias("line")))
    # 5. offers
    out.append(offers.select(*keys, F.lit(5).alias("section"), F.col("id").alias("pos"), F.format_string(
        "  - (%s, %s aggressiveness) %s", F.col("offer_type"), F.col("aggressiveness"), F.col("description")).alias("line")))
    has_of = offers.select(*keys).distinct()
    out.append(has_of.select(*keys, F.lit(5).alias("section"), F.lit(-1).cast("long").alias("pos"),
                             F.lit("Offers/promotions detected this scan:").alias("line")))
    out.append(scans.join(has_of, keys, "left_anti").select(*keys, F.lit(5).alias("section"), F.lit(-1).cast("long").alias("pos"),
                                                            F.lit("No new offers or promotions detected this scan.").alias("line")))
    res = out[0]
    for part in out[1:]:
        res = res.unionByName(part)
    return res


def comparison_context(scans: DataFrame, roster: DataFrame, changes: DataFrame, sentiment: DataFrame, news: DataFrame,
                       scores: DataFrame) -> DataFrame:
    """Per scan, one '## entity' section per scanned entity in roster order: every change,
    the sentiment line, the opportunity when present, the top-2 news and the current score.
    Lines carry (scan, entity_pos, entity, section, pos); sections are separated by a blank line."""
    keys = ["entity", "scan"]
    base = scans.join(roster.select("entity", "pos"), "entity").withColumnRenamed("pos", "entity_pos")
    out = [base.select("scan", "entity_pos", "entity", F.lit(0).alias("section"), F.lit(0).cast("long").alias("pos"),
                       F.concat(F.lit("## "), F.col("entity")).alias("line"))]
    out.append(changes.join(base, keys).select("scan", "entity_pos", "entity", F.lit(1).alias("section"), F.col("id").alias("pos"),
                                               F.format_string("- Website (%s): %s", F.col("change_type"), F.col("description")).alias("line")))
    sent = latest_by_id(sentiment.select(F.struct(*keys).alias("k"), "id", "sentiment", "severity_score", "themes", "opportunity"), "k")
    sent = base.join(sent.select("k.*", "sentiment", "severity_score", "themes", "opportunity"), keys, "left")
    themes = F.when(F.size(F.coalesce("themes", F.array())) > 0, F.array_join("themes", ", ")).otherwise(F.lit("none"))
    out.append(sent.select("scan", "entity_pos", "entity", F.lit(2).alias("section"), F.lit(0).cast("long").alias("pos"), F.format_string(
        "- App review sentiment: %s (severity %s/10), themes: %s", F.coalesce("sentiment", F.lit("neutral")),
        _num_text(F.coalesce(F.col("severity_score"), F.lit(K.REVIEW_BASELINE))), themes).alias("line")))
    out.append(sent.filter(F.coalesce(F.col("opportunity"), F.lit("")) != "").select(
        "scan", "entity_pos", "entity", F.lit(2).alias("section"), F.lit(1).cast("long").alias("pos"),
        F.concat(F.lit("  Opportunity: "), F.col("opportunity")).alias("line")))
    w = Window.partitionBy(*keys).orderBy(F.col("relevance").desc(), F.col("id").asc())
    top = news.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2).join(base, keys)
    out.append(top.select("scan", "entity_pos", "entity", F.lit(3).alias("section"), F.col("_r").cast("long").alias("pos"), F.format_string(
        "- News: %s (%s, relevance %s/10)", F.col("headline"), F.col("impact_type"), _num_text(F.col("relevance"))).alias("line")))
    sc = base.join(scores.select(*keys, "threat_score"), keys, "left")
    out.append(sc.select("scan", "entity_pos", "entity", F.lit(4).alias("section"), F.lit(0).cast("long").alias("pos"),
                         F.format_string("- Current threat score: %s/10", _num_text(F.col("threat_score"))).alias("line")))
    res = out[0]
    for part in out[1:]:
        res = res.unionByName(part)
    return res


def scan_summary(scans: DataFrame, changes: DataFrame, news: DataFrame, errors: DataFrame) -> DataFrame:
    """Per scan the entities scanned, total changes, total news, and its errors (scan, seq, error): their number and
    the list of their texts by seq."""
    n_ent = scans.groupBy("scan").agg(F.countDistinct("entity").alias("entities_scanned"))
    out = n_ent
    for rows, name in ((changes, "changes_found"), (news, "news_found")):
        out = out.join(rows.groupBy("scan").agg(F.count(F.lit(1)).alias(name)), "scan", "left")
    listed = errors.groupBy("scan").agg(F.count(F.lit(1)).alias("errors_found"),
                                        F.array_sort(F.collect_list(F.struct(
                                            F.col("seq").isNull().alias("_last"), "seq", "error"))).alias("_errors"))
    out = out.join(listed, "scan", "left")
    return out.select("scan", "entities_scanned", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("changes_found", "news_found", "errors_found")],
                      F.coalesce(F.transform("_errors", lambda x: x["error"]), F.array().cast("array<string>")).alias("errors"))


RATING_MARKS = {"green": "(+)", "yellow": "(~)", "red": "(-)"}


def weekly_brief(roster: DataFrame, scores: DataFrame, changes: DataFrame, sentiment: DataFrame, news: DataFrame,
                 cells: DataFrame, dims: DataFrame, describe=None) -> DataFrame:
    """The brief as one tidy DataFrame (section, rank, entity, metric, text), text folded to
    Latin-1 and cut at the brief's widths."""
    fold = S.fold_ascii
    # scores with trend
    lp = R.latest_and_previous(scores.select("entity", "id", "threat_score"), "threat_score")
    reasons = scores.select(F.col("id").alias("latest_id"), "reason")
    sc = roster.select("pos", "entity").join(lp, "entity").join(reasons, "latest_id")
    d = F.col("latest") - F.col("previous")
    trend = (F.when(F.col("previous").isNull(), "first scan").when(d > K.TREND_EPSILON, F.concat(F.lit("+"), S.fmt1(d)))
             .when(d < -K.TREND_EPSILON, S.fmt1(d)).otherwise("stable"))
    parts = [sc.select(F.lit("scores").alias("section"), F.col("pos").cast("long").alias("rank"), "entity",
                       S.fmt1(F.col("latest")).alias("metric"),
                       F.concat(trend, F.lit(" | "), fold(F.substring(F.coalesce("reason", F.lit("")), 1, K.BRIEF_REASON_CHARS))).alias("text"))]
    # top-5 changes by impact among the newest 500 with impact >= 2 (stable on the read order)
    newest = R.changes(changes, K.CHANGES_VIEW_LIMIT).filter(F.col("customer_impact_score") >= K.IMPACT_GATE_MIN)
    w = Window.orderBy(F.col("customer_impact_score").desc(), F.col("detected_at").desc(), F.col("id").desc())
    top_ch = newest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
    if describe is not None:
        # descriptions are attached to the five selected rows only
        top_ch = describe(top_ch)
    parts.append(top_ch.select(F.lit("changes").alias("section"), F.col("rank").cast("long").alias("rank"), "entity",
                               F.col("customer_impact_score").cast("string").alias("metric"),
                               fold(F.substring(F.coalesce("description", F.lit("")), 1, K.BRIEF_CHANGE_CHARS)).alias("text")))
    # first two complaints of each entity's latest review analysis
    lat = latest_by_id(sentiment.select("entity", "id", "top_complaints"))
    cm = roster.select("pos", "entity").join(lat, "entity").select(
        "pos", "entity", F.posexplode(F.slice(F.coalesce("top_complaints", F.array()), 1, 2)).alias("i", "c"))
    parts.append(cm.select(F.lit("complaints").alias("section"), (F.col("pos") * 10 + F.col("i")).cast("long").alias("rank"), "entity",
                           F.lit(None).cast("string").alias("metric"),
                           fold(F.substring("c", 1, K.BRIEF_COMPLAINT_CHARS)).alias("text")))
    # top-5 news by relevance of the newest-500 read
    nw = R.news(news, K.NEWS_VIEW_LIMIT, None, None)
    wn = Window.orderBy(F.col("relevance").desc(), F.col("fetched_at").desc(), F.col("id").desc())
    top_n = nw.withColumn("rank", F.row_number().over(wn)).filter(F.col("rank") <= 5)
    parts.append(top_n.select(F.lit("news").alias("section"), F.col("rank").cast("long").alias("rank"), "entity",
                              F.col("relevance").cast("string").alias("metric"),
                              fold(F.substring("headline", 1, K.BRIEF_NEWS_CHARS)).alias("text")))
    # matrix cells
    mark = F.coalesce(*[F.when(F.col("rating") == r, F.lit(m)) for r, m in RATING_MARKS.items()], F.lit("?"))
    mx = cells.join(dims, "dimension").join(roster.select("pos", "entity"), "entity")
    parts.append(mx.select(F.lit("matrix").alias("section"), (F.col("dim_pos") * 100 + F.col("pos")).cast("long").alias("rank"),
                           "entity", mark.alias("metric"),
                           fold(F.substring(F.concat_ws(": ", "dimension", "note"), 1, K.BRIEF_MATRIX_CHARS)).alias("text")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res
