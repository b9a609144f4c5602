"""Plan checks: no cartesian products, no row-at-a-time Python UDFs, and Arrow
batch nodes only in the operators that need Python (HTML parse, difflib, order-dependent folds)."""

import contextlib
import io

import __spark_entry__ as entry
from tidewatch.plans import QUERIES

from conftest import SF_SMALL

# query-name prefixes allowed to contain Arrow/pandas nodes
ARROW_OK = ("b1_", "b3_", "b4_", "b5_", "b6_", "b7_", "b8_", "b10_", "b11_", "b12_", "c4_", "c5_", "c6_", "c7_",
            "c8_", "c9_", "c10_", "c11_", "g3_changes_view", "g4_news_view", "s1_", "s2_", "s3_")
ARROW_NODES = ("ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_plans(spark):
    problems = []
    for name, fn in sorted(entry.queries().items()):
        if name not in QUERIES:  # optional operators have tests of their own
            continue
        plan = _plan(fn(spark, SF_SMALL))
        if "CartesianProduct" in plan:
            problems.append(f"{name}: cartesian product")
        if "BroadcastNestedLoopJoin" in plan and name != "a12_backfill_if_empty":
            problems.append(f"{name}: nested loop join")
        if "BatchEvalPython" in plan:
            problems.append(f"{name}: row-at-a-time Python UDF")
        if any(n in plan for n in ARROW_NODES) and not name.startswith(ARROW_OK):
            problems.append(f"{name}: unexpected Arrow node")
    assert problems == []


def test_reads_push_top_n_below_joins(spark):
    """The title join of F2 sees the surviving rows only: its input is the top-N node (higher ids are nearer the scan)."""
    tree = _plan(entry.queries()["f2_changes"](spark, SF_SMALL)).split("\n\n")[0]
    lines = tree.splitlines()
    join = min(k for k, line in enumerate(lines) if "Join" in line)
    top = [k for k, line in enumerate(lines) if "TakeOrderedAndProject" in line]
    assert any(k > join for k in top)
    scan = _plan(entry.queries()["f5_news"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in scan


def test_latest_rows_use_no_sort_aggregate(spark):
    for name in ("f6_latest_score", "f6_latest_sentiment", "f6_latest_social", "g11_social_cards"):
        assert "SortAggregate" not in _plan(entry.queries()[name](spark, SF_SMALL)), name


def test_watch_pages_collects_no_group(spark):
    assert "collect_list" not in _plan(entry.queries()["a2_watch_pages"](spark, SF_SMALL))
