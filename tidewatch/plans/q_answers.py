"""Answers of every kind, built from events with planted faults, parsed and flattened.

An answer is written as JSON text, field by field. A field's variants are (modulus, JSON text or none to leave it out,
the reason it gives): the first modulus that divides the event's number applies. The expressions are plain enough to
mean the same in Spark and in DuckDB, so the oracle derives the expected reasons from the numbers without parsing JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import answers as D
from ..sources import tables as T
from . import sql_bindings as B
from .registry import query

_ID = "CAST(event_id AS STRING)"


def _word(values: list[str], step: int = 1) -> str:
    """JSON text of one of the values, by event."""
    cases = " ".join(f"WHEN {k} THEN {B.q(chr(34) + v + chr(34))}" for k, v in enumerate(values[:-1]))
    return f"(CASE CAST(floor(event_id / {step}) AS BIGINT) % {len(values)} {cases} ELSE {B.q(chr(34) + values[-1] + chr(34))} END)"


def _say(text: str) -> str:
    return f"concat('\"{text} ', {_ID}, '\"')"


_ARTICLE = "concat('{\"impact_type\":', " + _word(K.NEWS_IMPACT_TYPES) + ", ',\"relevance\":', CAST(event_id % 13 AS STRING), ',\"market_impact\":', " \
    + _word(K.MARKET_IMPACTS) + ", ',\"summary\":', " + _say("summary") + ", '}')"
_DIMS = "concat('[{{\"dimension\":\"D', CAST({0} AS STRING), '\",\"rating\":', " + _word(K.COMPARISON_RATINGS) + ", ',\"note\":', " + _say("first") \
    + ", '}},{{\"dimension\":\"D', CAST({1} AS STRING), '\",\"rating\":\"red\",\"note\":', " + _say("second") + ", '}}]')"
_ENTRY = "concat('{\"entity\":\"E', CAST(event_id % 8 AS STRING), '\",\"dimensions\":', {0}, '}')"
_ENTRIES = ("concat('[', " + _ENTRY.replace("{0}", _DIMS.format("event_id % 5", "(event_id + 1) % 5")) + ", ',', "
            + _ENTRY.replace("event_id % 8", "(event_id + event_id % 2) % 8").replace("{0}", _DIMS.format("event_id % 3", "event_id % 2")) + ", ']')")

# kind -> its specification; per field the good text and the faulty variants; what a valid answer is checked by
KINDS = {
    "product": (D.PRODUCT_ANSWER, {
        "competitor_move": (_say("move"), [(19, "'7'", "type:competitor_move")]),
        "home_product": (_word(K.HOME_PRODUCTS), [(23, "'\"Other\"'", "enum:home_product")]),
        "threat_level": (_word(K.THREAT_LEVELS), [(29, "'null'", "type:threat_level")]),
        "recommended_action": (_say("act"), [(37, None, "missing:recommended_action")])}, "recommended_action", _say("act")),
    "social": (D.SOCIAL_ANSWER, {
        "messaging_theme": (_say("theme"), []),
        "campaign_focus": (_word(K.CAMPAIGN_FOCUS_OPTIONS), [(19, "'\"none\"'", "enum:campaign_focus")]),
        "target_segment_signals": ("concat('[', " + _word(K.SEGMENTS_AFFECTED) + ", ',\"SMB\"]')", [
            (23, "'[]'", "few:target_segment_signals"), (29, "'[\"SMB\",\"Nobody\"]'", "enum:target_segment_signals[1]"),
            (41, "'\"SMB\"'", "type:target_segment_signals")]),
        "tone_shift": (_word(K.TONE_SHIFT_OPTIONS), [(37, None, "missing:tone_shift")]),
        "opportunity": (_say("gap"), [])}, "target_segment_signals[1]", "'\"SMB\"'"),
    "offer": (D.OFFER_ANSWER, {
        "offer_type": (_word(K.OFFER_TYPES), [(19, "'\"gift\"'", "enum:offer_type")]),
        "target_segment": (_word(K.OFFER_TARGET_SEGMENTS), []), "aggressiveness": (_word(K.OFFER_AGGRESSIVENESS_LEVELS), []),
        "duration": (_word(K.OFFER_DURATIONS), [(23, "'[\"Ongoing\"]'", "type:duration")]),
        "home_match": (_word(K.OFFER_MATCH_VALUES), [(37, None, "missing:home_match")]),
        "description": (_say("offer"), [])}, "description", _say("offer")),
    "review": (D.REVIEW_ANSWER, {
        "sentiment": (_word(K.SENTIMENTS), [(19, "'\"mixed\"'", "enum:sentiment")]),
        "themes": ("'[]'", [(23, "'[\"fees\",3]'", "type:themes[1]")]),
        "severity_score": ("concat(CAST(event_id % 11 AS STRING), '.5')", [(29, "'\"7.5\"'", "type:severity_score")]),
        "top_complaints": ("concat('[', " + _say("slow") + ", ']')", []), "top_praise": ("'[\"fast\"]'", [(37, None, "missing:top_praise")]),
        "opportunity": (_say("win"), [])}, "top_complaints[0]", _say("slow")),
    "news": (D.NEWS_ANSWER, {"articles": ("concat('[', " + _ARTICLE + ", ',', " + _ARTICLE + ", ']')", [
        (19, "concat('[', " + _ARTICLE + ", ',7]')", "type:articles[1]"),
        (23, "concat('[', replace(" + _ARTICLE + ", '\"summary\"', '\"title\"'), ']')", "missing:articles[0].summary,extra:articles[0].title"),
        (29, "concat('[', " + _ARTICLE + ", ',', replace(" + _ARTICLE + ", '\"relevance\":', '\"relevance\":0.'), ']')", "type:articles[1].relevance"),
        (37, None, "missing:articles")])}, "articles[1].summary", _say("summary")),
    "comparison": (D.COMPARISON_ANSWER, {
        "comparisons": (_ENTRIES, [
            (19, "replace(" + _ENTRIES + ", '\"rating\":\"red\",\"note\":\"second ', '\"rating\":\"pink\",\"note\":\"second ')",
             "enum:comparisons[0].dimensions[1].rating,enum:comparisons[1].dimensions[1].rating"),
            (23, "'[{\"entity\":\"E0\"}]'", "missing:comparisons[0].dimensions")]),
        "top_threats": ("'[\"a\",\"b\"]'", [(37, None, "missing:top_threats")]),
        "top_advantages": ("concat('[', " + _say("edge") + ", ']')", [])}, "top_advantages[0]", _say("edge")),
    "reason": (D.REASON_ANSWER, {"reason": (_say("because"), [(19, "'[]'", "type:reason"), (37, None, "missing:reason")])},
               "reason", _say("because")),
}


def _field(name: str, good: str, variants: list) -> str:
    """SQL of a field's JSON text, null where it is left out."""
    cases = " ".join(f"WHEN event_id % {m} = 0 THEN {'NULL' if v is None else v}" for m, v, _ in variants)
    value = f"CASE {cases} ELSE {good} END" if variants else good
    return f"concat('\"{name}\":', {value})"


def _answers(spark, sf_dir, kind: str):
    """(id, answer): every 17th is cut off in an open list, every 31st has another key. An answer costs far more to write and
    parse than its event's bytes to read, so events that come in few partitions are dealt to all cores first."""
    _, fields, _, _ = KINDS[kind]
    parts = [f"CASE WHEN event_id % 31 = 0 THEN '\"zz\":1' END", *(_field(n, *f) for n, f in fields.items())]
    whole = f"concat('{{', array_join(array_compact(array({', '.join(parts)})), ','), '}}')"
    events = T.Raw(spark, sf_dir).table("events").select("event_id")
    cores = 4 * spark.sparkContext.defaultParallelism
    if events.rdd.getNumPartitions() < cores:
        events = events.repartition(cores)
    return events.select(
        F.col("event_id").alias("id"), F.expr(f"CASE WHEN event_id % 17 = 0 THEN concat('[', substring({whole}, 1, 12)) ELSE {whole} END").alias("answer"))


def _reason_sql(kind: str) -> str:
    _, fields, _, _ = KINDS[kind]
    found = []
    for _, variants in fields.values():
        if variants:
            found.append("CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN {B.q(r)}" for m, _, r in variants) + " END")
    found.append("CASE WHEN event_id % 31 = 0 THEN 'extra:zz' END")
    return f"CASE WHEN event_id % 17 = 0 THEN 'invalid_json' ELSE array_to_string(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL), ',') END"


def _parse_sql(kind: str) -> str:
    sample = KINDS[kind][3].replace("AS STRING", "AS VARCHAR")
    return (f"SELECT id, reasons, CASE WHEN reasons = '' THEN sample END AS sample FROM (SELECT event_id AS id, {_reason_sql(kind)} AS reasons, "
            f"replace({sample}, chr(34), '') AS sample FROM events)")


def _register(kind: str) -> None:
    spec, _, sample, _ = KINDS[kind]

    @query(f"d2_{kind}_answers", _parse_sql(kind))
    def run(spark, sf_dir):
        parsed = D.parse_answers(_answers(spark, sf_dir, kind), spec)
        return parsed.select("id", F.array_join("reasons", ",").alias("reasons"),
                             F.when(F.size("reasons") == 0, F.expr(sample)).alias("sample"))


for _kind in KINDS:
    _register(_kind)


def _cells_sql() -> str:
    """The last entry of an entity, and in it the last of a dimension, from the numbers of a valid answer."""
    first = _word(K.COMPARISON_RATINGS).replace("AS STRING", "AS VARCHAR")
    rows = []
    for entry, entity, dims in ((0, "event_id % 8", ("event_id % 5", "(event_id + 1) % 5")),
                                (1, "(event_id + event_id % 2) % 8", ("event_id % 3", "event_id % 2"))):
        for k, (dim, rating, note) in enumerate(zip(dims, (f"replace({first}, chr(34), '')", "'red'"), ("first", "second"))):
            rows.append(f"SELECT event_id AS card_id, {entry} AS ei, {k} AS di, 'E' || CAST({entity} AS VARCHAR) AS entity, 'D' || CAST({dim} AS VARCHAR) "
                        f"AS dimension, {rating} AS rating, '{note} ' || CAST(event_id AS VARCHAR) AS note FROM events WHERE {_reason_sql('comparison')} = ''")
    return ("SELECT card_id, entity, dimension, rating, note FROM (SELECT *, max(ei) OVER (PARTITION BY card_id, entity) AS top, "
            "row_number() OVER (PARTITION BY card_id, entity, ei, dimension ORDER BY di DESC) AS r FROM (" + " UNION ALL ".join(rows) + ")) "
            "WHERE ei = top AND r = 1")


@query("d7_flatten_answers", _cells_sql())
def d7_flatten_answers(spark, sf_dir):
    """The ratings of every valid comparison answer."""
    parsed = D.valid(D.parse_answers(_answers(spark, sf_dir, "comparison"), D.COMPARISON_ANSWER))
    return D.flatten_comparison(parsed.select(F.col("id").alias("card_id"), "comparisons"))
