"""Scoring and KPI boundary goldens (FIXTURES section 5: E4/E5, E6, G1)."""

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.operators import scoring as E
from tidewatch.operators import views as G
from tidewatch.sources import tables as T


def _py_score(review, news, velocity, static, social, offers):
    w = K.SIGNAL_WEIGHTS
    total = (w["review"] * review + w["news"] * news + w["velocity"] * velocity + w["static"] * static
             + w["social"] * social + w["offers"] * offers)
    return round(max(1.0, min(10.0, total)), 1)


def test_composite_boundaries(spark):
    roster = T.literal_table(spark, [(0, "A", 1), (1, "B", 10), (2, "C", 3), (3, "D", None)],
                             "pos int, entity string, static_weight int")
    review = spark.createDataFrame([("A", 1.0), ("B", 10.0), ("C", 4.45)], "entity string, review_value double")
    news = spark.createDataFrame([("A", 1.0), ("B", 10.0), ("C", 0.15)], "entity string, news_value double")
    velocity = spark.createDataFrame([("A", 1.0), ("B", 10.0), ("C", 0.35)], "entity string, velocity_value double")
    social = spark.createDataFrame([("A", 1.0), ("B", 10.0), ("C", 0.25)], "entity string, social_value double")
    offers = spark.createDataFrame([("A", 1.0), ("B", 10.0), ("C", 4.45)], "entity string, offers_value double")
    out = {r.entity: r for r in E.composite_score(roster, review, news, velocity, social, offers).collect()}
    assert out["A"].threat_score == 1.0 and out["B"].threat_score == 10.0
    assert out["C"].threat_score == _py_score(4.45, 0.15, 0.35, 3.0, 0.25, 4.45)
    assert (out["C"].news_component, out["C"].feature_velocity_component, out["C"].social_component,
            out["C"].review_component) == (round(0.15, 1), round(0.35, 1), round(0.25, 1), round(4.45, 1))
    d = out["D"]   # nothing at all: every baseline and the default static weight
    assert (d.review_component, d.news_component, d.feature_velocity_component, d.smb_relevance_component,
            d.social_component, d.offers_component) == (5.0, 3.0, 2.0, 5.0, 5.0, 3.0)
    assert d.threat_score == _py_score(5.0, 3.0, 2.0, 5.0, 5.0, 3.0)


def test_social_and_offers_components(spark):
    so = spark.createDataFrame([(1, "A", "More aggressive", "Merchant acquisition"), (2, "A", "Unclear", "Other"),
                                (3, "B", "Retreating", "Brand awareness")],
                               "id long, entity string, tone_shift string, campaign_focus string")
    got = {r.entity: r.social_value for r in E.social_component(None, so).collect()}
    assert got == {"A": 5.0, "B": 2.5}
    rows = [(i, "A", f"2024-01-{i + 1:02d} 00:00:00", "High" if i % 2 else "Weird") for i in range(11)]
    of = spark.createDataFrame(rows, "id long, entity string, t string, aggressiveness string").withColumn(
        "detected_at", F.to_timestamp("t"))
    # the latest 10 of 11 offers: ids 1..10 -> 5 High (9.0) and 5 unknown (5.0)
    assert E.offers_component(of).first().offers_value == (5 * 9.0 + 5 * 5.0) / 10


def test_kpi_deltas(spark):
    rows = [(1, "A", 5.0), (2, "A", 5.05), (3, "B", 5.0), (4, "B", 5.06), (5, "C", 5.06), (6, "C", 5.0),
            (7, "D", 5.0), (8, "D", 4.94), (9, "E", 7.0)]
    scores = spark.createDataFrame(rows, "id long, entity string, threat_score double")
    roster = T.literal_table(spark, [(i, e) for i, e in enumerate("ABCDEF")], "pos int, entity string")
    got = {r.entity: (r.trend, r.delta_label) for r in G.kpi_strip(roster, scores).collect()}

    def py(prev, cur):
        d = cur - prev
        return ("up", f"+{d:.1f}") if d > 0.05 else (("down", f"{d:.1f}") if d < -0.05 else ("stable", None))

    assert got["A"] == py(5.0, 5.05) and got["B"] == py(5.0, 5.06)
    assert got["C"] == py(5.06, 5.0) and got["D"] == py(5.0, 4.94)
    assert got["E"] == ("first scan", None) and got["F"] == ("no data", None)
