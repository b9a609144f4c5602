"""The classification contract. Model answers arrive as JSON text rows; they are parsed,
validated against the task schema, clamped, aligned with their inputs and repaired natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S

# Task schemas. Every field of a record is required and no other key is allowed; a specification is nested data that
# `parse_answers` compiles into expressions over a VARIANT.


def text(enum: list[str] | None = None) -> dict:
    return {"kind": "text", "enum": enum}


def whole() -> dict:
    return {"kind": "whole"}


def number() -> dict:
    return {"kind": "number"}


def items(of: dict, least: int = 0) -> dict:
    return {"kind": "items", "of": of, "least": least}


def record(**fields: dict) -> dict:
    return {"kind": "record", "fields": fields}


CHANGE_ANSWER = record(
    change_type=text(K.CHANGE_TYPES), description=text(), customer_impact_score=whole(),
    revenue_sensitivity=text(K.REVENUE_SENSITIVITY_LEVELS), segment_affected=text(K.SEGMENTS_AFFECTED))
PRODUCT_ANSWER = record(
    competitor_move=text(), home_product=text(K.HOME_PRODUCTS), threat_level=text(K.THREAT_LEVELS), recommended_action=text())
SOCIAL_ANSWER = record(
    messaging_theme=text(), campaign_focus=text(K.CAMPAIGN_FOCUS_OPTIONS),
    target_segment_signals=items(text(K.SEGMENTS_AFFECTED), least=1), tone_shift=text(K.TONE_SHIFT_OPTIONS), opportunity=text())
OFFER_ANSWER = record(
    offer_type=text(K.OFFER_TYPES), target_segment=text(K.OFFER_TARGET_SEGMENTS),
    aggressiveness=text(K.OFFER_AGGRESSIVENESS_LEVELS), duration=text(K.OFFER_DURATIONS), home_match=text(K.OFFER_MATCH_VALUES),
    description=text())
REVIEW_ANSWER = record(
    sentiment=text(K.SENTIMENTS), themes=items(text()), severity_score=number(), top_complaints=items(text()),
    top_praise=items(text()), opportunity=text())
NEWS_ANSWER = record(articles=items(record(
    impact_type=text(K.NEWS_IMPACT_TYPES), relevance=whole(), market_impact=text(K.MARKET_IMPACTS), summary=text())))
COMPARISON_ANSWER = record(
    comparisons=items(record(entity=text(), dimensions=items(record(
        dimension=text(), rating=text(K.COMPARISON_RATINGS), note=text())))),
    top_threats=items(text()), top_advantages=items(text()))
REASON_ANSWER = record(reason=text())

_SIMPLE = {"text": "string", "whole": "int", "number": "double"}


def answer_type(spec: dict) -> str:
    """The Spark type of a specification."""
    if spec["kind"] == "items":
        return f"array<{answer_type(spec['of'])}>"
    if spec["kind"] == "record":
        return "struct<" + ", ".join(f"{k}: {answer_type(v)}" for k, v in spec["fields"].items()) + ">"
    return _SIMPLE[spec["kind"]]


def _with(value: Column, then) -> Column:
    """`then(value)`, where the value is computed once, however often the result names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _reasons(value: Column, spec: dict, path: Column | None) -> Column:
    """Everything in which a VARIANT departs from its specification, as `fault:path`."""
    def say(fault: str, *more: Column) -> Column:
        return F.array(F.concat(F.lit(fault + ":"), *([path] if path is not None else []), *more))

    def below(field: str) -> Column:
        return F.lit(field) if path is None else F.concat(path, F.lit("." + field))

    none = F.array().cast("array<string>")
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    if spec["kind"] == "text":
        if spec["enum"] is None:
            return F.when(kind == "STRING", none).otherwise(say("type"))
        known = F.coalesce(F.try_variant_get(value, "$", "string").isin(*spec["enum"]), F.lit(False))
        return F.when(kind != "STRING", say("type")).when(~known, say("enum")).otherwise(none)
    if spec["kind"] == "whole":
        return F.when(kind == "BIGINT", none).otherwise(say("type"))
    if spec["kind"] == "number":
        return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), none).otherwise(say("type"))
    # the kinds of lists and records are told apart by a cast: their full schema is that of everything below
    if spec["kind"] == "items":
        at = path if path is not None else F.lit("")

        def of_list(parts: Column) -> Column:
            found = F.flatten(F.transform(parts, lambda x, i: _reasons(
                x, spec["of"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
            few = F.when(F.size(parts) < spec["least"], say("few")).otherwise(none)
            return F.when(parts.isNotNull(), F.concat(few, found)).otherwise(say("type"))

        return _with(F.try_variant_get(value, "$", "array<variant>"), of_list)
    where = [] if path is None else [F.lit(".")]

    def of_record(members: Column) -> Column:
        keys = F.map_keys(members)
        faults = [F.when(F.map_contains_key(members, f), _reasons(members[f], sub, below(f)))
                  .otherwise(F.array(F.concat(F.lit("missing:"), below(f)))) for f, sub in spec["fields"].items()]
        extra = F.array_except(keys, F.array(*map(F.lit, spec["fields"])))
        faults.append(_with(extra, lambda e: F.when(
            F.size(e) > 0, say("extra", *where, F.array_join(F.array_sort(e), ","))).otherwise(none)))
        return F.when(members.isNotNull(), F.concat(*faults)).otherwise(say("type") if path is not None else F.array(F.lit("invalid_json")))

    return _with(F.try_variant_get(value, "$", "map<string, variant>"), of_record)


def parse_answers(df: DataFrame, spec: dict, json_col: str = "answer") -> DataFrame:
    """Parse the JSON answer against a record specification, once.

    `reasons` (empty: valid) names invalid JSON, missing and extra keys, wrong types (a JSON null, a number for a string
    or a quoted number for an integer is one), values outside an enumeration and lists that are too short, at
    any depth, with their paths. The record's fields are added in their types. The answer comes out of a generator, so that
    no filter or projection above repeats the parse.
    """
    def of_answer(v: Column) -> Column:
        fields = [F.try_variant_get(v, f"$.{k}", answer_type(t)).alias(k) for k, t in spec["fields"].items()]
        return F.struct(*fields, _reasons(v, spec, None).alias("reasons"))

    return df.select(*df.columns, F.inline(F.transform(F.array(F.try_parse_json(F.col(json_col))), of_answer)))


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reasons") == 0)


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reasons") > 0)


def clamp_score(col) -> Column:
    """D3: impact / relevance as int clamped to 1..10."""
    return S.clamp_int(col, 1, 10)


def clamp_severity(col) -> Column:
    """D3: severity clamped to 1..10 then rounded to one decimal as Python does."""
    return S.round1(S.clamp(F.col(col).cast("double") if isinstance(col, str) else col.cast("double"), 1.0, 10.0))


def align_answers(inputs: DataFrame, answers: DataFrame, batch: str = "batch_id") -> DataFrame:
    """answers[i] belongs to inputs[i] within a batch: extra answers dropped, missing ones
    padded with the fixed default classification; relevance clamped.
    inputs: batch, pos, ...; answers: batch, pos, impact_type, relevance, market_impact, summary."""
    pad = K.NEWS_ANSWER_PAD
    j = inputs.join(answers, [batch, "pos"], "left")
    return j.select(
        *inputs.columns,
        F.coalesce("impact_type", F.lit(pad["impact_type"])).alias("impact_type"),
        clamp_score(F.coalesce(F.col("relevance"), F.lit(pad["relevance"]))).alias("relevance"),
        F.coalesce("market_impact", F.lit(pad["market_impact"])).alias("market_impact"),
        F.coalesce("summary", F.lit(pad["summary"])).alias("summary"))


def repair_blank(df: DataFrame, text: str = "recommended_action", product: str = "home_product",
                 level: str = "threat_level") -> DataFrame:
    """A text without any ASCII letter or digit becomes a templated recommendation, by gap
    label and lower-cased threat level (default medium)."""
    lvl = F.lower(F.coalesce(F.col(level), F.lit("Medium")))
    gap = F.format_string("Evaluate whether the home side should build or partner to close this gap, given the %s threat level.", lvl)
    team = F.format_string("Have the %s team review this change and assess a response, given the %s threat level.",
                           F.col(product), lvl)
    fixed = F.when(F.col(product) == K.GAP_LABEL, gap).otherwise(team)
    return df.withColumn(text, F.when(S.is_blank(F.col(text)), fixed).otherwise(F.col(text)))


def default_sentiment(entities: DataFrame, review_counts: DataFrame, answers: DataFrame) -> DataFrame:
    """Per entity the analysed sentiment, or neutral / 5.0 / empty lists when there was no
    review or the classifier failed (with a text naming the review count); the source map holds
    {'app store': count} when reviews exist, else {}."""
    j = entities.join(review_counts, "entity", "left").join(answers, "entity", "left")
    n = F.coalesce(F.col("review_count"), F.lit(0))
    failed_text = F.when(n > 0, F.format_string("Found %d app review(s) but the analysis failed this scan.", n)).otherwise(
        F.lit("No app reviews found for this entity in this scan."))
    empty = F.array().cast("array<string>")
    has = F.col("sentiment").isNotNull()
    return j.select(
        "entity", n.alias("review_count"),
        F.when(has, F.col("sentiment")).otherwise(F.lit("neutral")).alias("sentiment"),
        F.when(has, clamp_severity("severity_score")).otherwise(F.lit(K.REVIEW_BASELINE)).alias("severity_score"),
        F.when(has, F.col("themes")).otherwise(empty).alias("themes"),
        F.when(has, F.col("opportunity")).otherwise(failed_text).alias("opportunity"),
        F.when(n > 0, F.create_map(F.lit("app store"), n)).otherwise(F.create_map().cast("map<string,bigint>")).alias("source_breakdown"),
    )


def build_news_request(items: DataFrame, batch: str = "entity") -> DataFrame:
    """Numbered headline list per batch: i. "headline" - source: s (w-credibility), published: d."""
    line = F.format_string('%d. "%s" - source: %s (%s-credibility), published: %s', F.col("pos"), F.col("headline"),
                           F.col("source"), F.col("source_weight"), F.coalesce(F.col("published_at"), F.lit("")))
    agg = items.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))
    return agg.select(batch, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("request"))


def build_review_request(reviews: DataFrame, batch: str = "entity") -> DataFrame:
    """Review blocks '[r/5 stars | date]' + body joined by '---', empty bodies skipped."""
    block = F.format_string("[%d/5 stars | %s]\n%s", F.col("rating"), F.col("date"), F.col("body"))
    kept = reviews.filter(F.coalesce(F.col("body"), F.lit("")) != "")
    agg = kept.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("feed_pos", block.alias("b")))).alias("ls"))
    return agg.select(batch, F.array_join(F.transform("ls", lambda x: x["b"]), "\n---\n").alias("request"))


def flatten_comparison(cards: DataFrame) -> DataFrame:
    """The nested answer (card_id, comparisons: list of entity -> list of dimension ratings) in long form. An
    entity named again replaces what an earlier entry said of it, and a dimension named again within an entry likewise."""
    entries = cards.select("card_id", F.posexplode("comparisons").alias("ei", "c")).select(
        "card_id", "ei", F.col("c.entity").alias("entity"), F.col("c.dimensions").alias("dims"))
    last = entries.groupBy("card_id", "entity").agg(F.max_by("dims", "ei").alias("dims"))
    rows = last.select("card_id", "entity", F.posexplode("dims").alias("di", "d"))
    kept = rows.groupBy("card_id", "entity", F.col("d.dimension").alias("dimension")).agg(
        F.max_by(F.struct("d.rating", "d.note"), "di").alias("cell"))
    return kept.select("card_id", "entity", "dimension", "cell.rating", "cell.note")


def build_social_request(batches: DataFrame, mentions: DataFrame, videos: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch the mention headlines and the video titles as '- ' bullet lists, each
    '(no results)' when empty. mentions/videos carry (batch, pos, text)."""
    def bullets(df, name):
        agg = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), F.col("text")).alias("l")))).alias("ls"))
        return agg.select(batch, F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias(name))
    j = batches.select(batch).join(bullets(mentions, "mention_lines"), batch, "left").join(bullets(videos, "video_lines"), batch, "left")
    return j.select(batch, F.coalesce("mention_lines", F.lit("(no results)")).alias("mention_lines"),
                    F.coalesce("video_lines", F.lit("(no results)")).alias("video_lines"))
