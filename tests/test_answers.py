"""Classification contract and feed parsing on hand-written fixtures (FIXTURES sections 2-3)."""

import json

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.operators import answers as D
from tidewatch.operators import ingest as A

GOOD = {"change_type": "pricing", "description": "Flat rate cut", "customer_impact_score": 7,
        "revenue_sensitivity": "high", "segment_affected": "SMB"}


def _answers(spark, rows):
    return spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "id long, answer string")


def test_parse_answers_faults(spark):
    rows = [
        json.dumps(GOOD),
        json.dumps(GOOD)[:25],                                              # truncated
        json.dumps({k: v for k, v in GOOD.items() if k != "segment_affected"}),  # missing field
        json.dumps({**GOOD, "change_type": "Pricing!"}),                     # unknown enum
        json.dumps({**GOOD, "extra": 1}),                                    # extra key
        json.dumps({**GOOD, "customer_impact_score": 0}),                    # clamped to 1
        json.dumps({**GOOD, "customer_impact_score": 11}),                   # clamped to 10
        json.dumps({**GOOD, "customer_impact_score": "seven"}),              # wrong type
        json.dumps({**GOOD, "customer_impact_score": "7"}),                  # a quoted number
        json.dumps({**GOOD, "description": 3}),                              # a number for a string
        json.dumps(dict.fromkeys(GOOD)),                                     # null everywhere
    ]
    p = D.parse_answers(_answers(spark, rows), D.CHANGE_ANSWER)
    got = {r.id: (r.reasons, r.score) for r in p.select(
        "id", "reasons", D.clamp_score(F.col("customer_impact_score")).alias("score")).collect()}
    assert got[0] == ([], 7)
    assert got[1][0] == ["invalid_json"]
    assert got[2][0] == ["missing:segment_affected"]
    assert got[3][0] == ["enum:change_type"]
    assert got[4][0] == ["extra:extra"]
    assert got[5] == ([], 1) and got[6] == ([], 10)
    assert got[7][0] == got[8][0] == ["type:customer_impact_score"]
    assert got[9][0] == ["type:description"]
    assert got[10][0] == [f"type:{k}" for k in GOOD]


def test_nested_answers(spark):
    article = {"impact_type": "funding", "relevance": 3, "market_impact": "low", "summary": "s"}
    rows = [{"articles": [article, article]}, {"articles": []}, {"articles": article}, {"articles": [article, {**article, "relevance": 3.5}]},
            {"articles": [{**article, "x": 1, "a": 2}, None, "t"]}, {"articles": [article, {"summary": 4, "impact_type": "war"}]}, [], None]
    p = D.parse_answers(_answers(spark, map(json.dumps, rows)), D.NEWS_ANSWER).orderBy("id").collect()
    assert [r.reasons for r in p] == [
        [], [], ["type:articles"], ["type:articles[1].relevance"],
        ["extra:articles[0].a,x", "type:articles[1]", "type:articles[2]"],
        ["enum:articles[1].impact_type", "missing:articles[1].relevance", "missing:articles[1].market_impact", "type:articles[1].summary"],
        ["invalid_json"], ["invalid_json"]]
    assert [a.summary for a in p[0].articles] == ["s", "s"] and p[1].articles == []
    social = {"messaging_theme": "m", "campaign_focus": "Brand awareness", "target_segment_signals": [], "tone_shift": "Stable", "opportunity": "o"}
    rows = [social, {**social, "target_segment_signals": ["SMB", "LAKA"]}, {**social, "target_segment_signals": ["SMB", None]}]
    p = D.parse_answers(_answers(spark, map(json.dumps, rows)), D.SOCIAL_ANSWER).orderBy("id").collect()
    assert [r.reasons for r in p] == [["few:target_segment_signals"], [], ["type:target_segment_signals[1]"]]
    review = {"sentiment": "positive", "themes": ["t"], "severity_score": 7, "top_complaints": [], "top_praise": [], "opportunity": "o"}
    p = D.parse_answers(_answers(spark, map(json.dumps, [review, {**review, "severity_score": 7.25}, {**review, "severity_score": True}])), D.REVIEW_ANSWER)
    assert [(r.reasons, r.severity_score) for r in p.orderBy("id").collect()] == [([], 7.0), ([], 7.25), (["type:severity_score"], p.where("id = 2").first().severity_score)]


def test_flatten_replaces_an_entity_named_again(spark):
    dim = lambda d, r: {"dimension": d, "rating": r, "note": f"{d}{r}"}
    card = {"comparisons": [{"entity": "E1", "dimensions": [dim("a", "red"), dim("b", "red")]}, {"entity": "E2", "dimensions": []},
                            {"entity": "E1", "dimensions": [dim("a", "green"), dim("c", "red"), dim("a", "yellow")]}],
            "top_threats": [], "top_advantages": ["x"]}
    p = D.valid(D.parse_answers(_answers(spark, [json.dumps(card)]), D.COMPARISON_ANSWER))
    got = D.flatten_comparison(p.select(F.col("id").alias("card_id"), "comparisons")).collect()
    assert sorted((r.entity, r.dimension, r.rating) for r in got) == [("E1", "a", "yellow"), ("E1", "c", "red")]


def test_repair_blank_and_align(spark):
    df = spark.createDataFrame([(1, " : ", K.GAP_LABEL, "High"), (2, "", "Tap to pay", None), (3, "Act now", "Tap to pay", "Low")],
                               "id long, recommended_action string, home_product string, threat_level string")
    got = {r.id: r.recommended_action for r in D.repair_blank(df).collect()}
    assert got[1].endswith("given the high threat level.") and "close this gap" in got[1]
    assert got[2] == "Have the Tap to pay team review this change and assess a response, given the medium threat level."
    assert got[3] == "Act now"
    inputs = spark.createDataFrame([("b", 1, "h1"), ("b", 2, "h2"), ("b", 3, "h3")], "batch_id string, pos int, headline string")
    answers = spark.createDataFrame([("b", 1, "funding", 12, "high", "s1"), ("b", 2, "other", 0, "low", "s2"),
                                     ("b", 4, "funding", 5, "low", "extra")],
                                    "batch_id string, pos int, impact_type string, relevance int, market_impact string, summary string")
    al = {r.pos: (r.impact_type, r.relevance, r.summary) for r in D.align_answers(inputs, answers).collect()}
    assert al == {1: ("funding", 10, "s1"), 2: ("other", 1, "s2"), 3: ("other", 1, "")}


def test_feeds_malformed_and_atom(spark):
    rss = ('<rss><channel><item><title> A story - Reuters </title><link>l1</link></item>'
           '<item><title>Dup link</title><link>l1</link></item><item><title></title><link>l2</link></item>'
           '<item><title>Headline - Some Source</title><link>l3</link></item></channel></rss>')
    feeds = spark.createDataFrame([(1, rss), (2, "<rss><channel><item><title>broken")], "feed long, xml string")
    items = [(r.feed, r.headline, r.source) for r in A.parse_news_feed(feeds).orderBy("feed", "pos").collect()]
    assert items == [(1, "A story - Reuters", "Reuters"), (1, "Headline - Some Source", "Some Source")]
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="http://www.youtube.com/xml/schemas/2015" '
            'xmlns:media="http://search.yahoo.com/mrss/"><entry><yt:videoId>v1</yt:videoId><title>T1</title>'
            '<link rel="alternate" href="https://v/1"/><published>2024-01-01T00:00:00+00:00</published><media:group>'
            '<media:thumbnail url="https://img/1.jpg"/><media:description>' + ("word " * 60) + '</media:description>'
            '</media:group></entry><entry><yt:videoId>v2</yt:videoId><title></title></entry></feed>')
    v = A.parse_video_feed(spark.createDataFrame([(1, atom)], "feed long, xml string")).collect()
    assert [(r.video_id, r.url, r.thumbnail_url) for r in v] == [("v1", "https://v/1", "https://img/1.jpg")]
    want = ("word " * 60).strip()[:200].rsplit(" ", 1)[0] + "…"
    assert v[0].description == want


def test_an_answer_is_parsed_once(spark):
    """Neither a filter on the reasons nor the fields named above it repeat the parse."""
    import contextlib
    import io

    p = D.valid(D.parse_answers(_answers(spark, ["{}"]), D.COMPARISON_ANSWER)).select("comparisons", "top_threats", "reasons")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        p.explain(mode="simple")
    assert buf.getvalue().count("try_parse_json") == 1 or buf.getvalue().lower().count("parsejson") == 1, buf.getvalue()


def test_scan_summary_lists_every_error(spark):
    from tidewatch.operators import summaries as M

    scans = spark.createDataFrame([("E0", 1), ("E1", 1), ("E0", 2)], "entity string, scan int")
    rows = spark.createDataFrame([(1,), (1,)], "scan int")
    errors = spark.createDataFrame([(1, 9, "late"), (1, 3, "early"), (7, 1, "no such scan")], "scan int, seq long, error string")
    got = sorted(tuple(r) for r in M.scan_summary(scans, rows, rows, errors).collect())
    assert got == [(1, 2, 2, 2, 2, ["early", "late"]), (2, 1, 0, 0, 0, [])]
