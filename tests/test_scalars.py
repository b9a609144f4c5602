"""Column functions against their Python statements."""

import math
import re
from datetime import datetime

from pyspark.sql import functions as F

import reference_model as M
from tidewatch.functions import constants as K
from tidewatch.functions import scalars as S


def test_round1_matches_python(spark):
    vals = [i / 1000 for i in range(0, 12001, 7)] + [0.15, 0.25, 0.35, 4.45, 2.675, 1.05, 9.95, 0.05]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [(r.x, r.r) for r in df.select("x", S.round1("x").alias("r")).collect()]
    assert all(round(x, 1) == r for x, r in got)


def test_clamp_int(spark):
    df = spark.createDataFrame([(0.0,), (11.0,), (5.9,), (None,)], "x double")
    assert [r.c for r in df.select(S.clamp_int("x").alias("c")).collect()] == [1, 10, 5, None]


def test_lenient_timestamp_zoo(spark):
    five = datetime(2024, 1, 30, 5)
    zoo = [("Tue, 30 Jan 2024 05:00:00 GMT", five), ("Tue, 30 Jan 2024 07:00:00 +0200", five), ("30 Jan 2024 05:00:00 GMT", five),
           ("2024-01-30T05:00:00Z", five), ("2024-01-30T00:00:00-05:00", five), ("2024-01-30T05:00:00", five),
           ("2024-01-30", datetime(2024, 1, 30)), ("2024-01-30 05:00:00", five), ("garbage", None), ("", None), (None, None)]
    df = spark.createDataFrame([(z,) for z, _ in zoo], "s string")
    got = [r.t for r in df.select(S.lenient_timestamp("s").alias("t")).collect()]
    assert got == [want for _, want in zoo]


def test_lenient_timestamp_reads_mail_headers(spark):
    from datetime import timezone
    from email.utils import parsedate_to_datetime

    mails = ["Mon, 02 Jan 2023 10:00:00 EST", "2 Jan 2023 10:00:00 PDT", "02 Jan 23 10:00:00 GMT", "02 Jan 99 10:00 +0130", "Mon,  2 Jan 2023 10:00:00",
             "Mon, 02 Jan 2023 10:00:00 -0000", "2 Jan 2023 10:00:00 cst", "2 Jan 2023 10:00:00 UT", "2 Jan 68 23:59:59 MDT"]
    want = [parsedate_to_datetime(m) for m in mails]
    want = [(w.astimezone(timezone.utc) if w.tzinfo else w).replace(tzinfo=None) for w in want]
    isos = {"2023-01-02T10:00:00+0000": datetime(2023, 1, 2, 10), "2023-01-02T10:00:00-0530": datetime(2023, 1, 2, 15, 30),
            "2023-01-02 10:00": datetime(2023, 1, 2, 10), "2023-13-02": None, "1 Foo 2023 10:00:00 GMT": None}
    df = spark.createDataFrame([(k, m) for k, m in enumerate([*mails, *isos])], "k int, s string")
    assert [r.t for r in df.orderBy("k").select(S.lenient_timestamp("s").alias("t")).collect()] == want + list(isos.values())


def test_clean_and_normalize(spark):
    texts = ["  a  b\tc\n", "Headline one - Reuters", "Well-known fact", "no suffix", "", None, " - Only",
             "A  B - C - Source Name"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(S.clean_text("t").alias("c"), S.normalize_headline("t").alias("n")).collect()
    assert [r.c for r in rows] == [re.sub(r"\s+", " ", t or "").strip() for t in texts]
    assert [r.n for r in rows] == [M.headline_key(t) for t in texts]


def test_tokens_and_source_rules(spark):
    texts = ["The new Pricing plan is now live for SMB merchants", "a an the", "Reuters and BLOOMBERG wire",
             "Yahoo! Finance Canada", "Local blog"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(S.tokens("t").alias("tk"), S.source_weight("t").alias("w"), S.source_rank("t").alias("r")).collect()
    for t, r in zip(texts, rows):
        assert sorted(r.tk) == sorted(M.words_of(t))
        assert r.r == M.credibility(t)
        assert r.w == ("high" if any(h in t.lower() for h in K.HIGH_VALUE_SOURCES) else "low")


def test_bands_and_fold(spark):
    df = spark.createDataFrame([("7",), ("6.9",), ("4",), ("3.99",), ("x",), (None,)], "s string")
    got = [r.b for r in df.select(S.score_band("s").alias("b")).collect()]
    assert got == ["high", "mid", "mid", "low", "grey", "grey"]
    text = "Price — “quoted” … 50½ → done 中文 ©"
    folded = spark.createDataFrame([(text,)], "t string").select(S.fold_ascii("t").alias("f")).first().f
    want = text
    for a, b in K.ASCII_FOLD:
        want = want.replace(a, b)
    assert folded == want.encode("latin-1", errors="replace").decode("latin-1")
