"""DuckDB SQL for the oracle side: the logical-table binding and shared scalar expressions.

These strings restate `tidewatch.sources.tables` and `tidewatch.functions.scalars` in DuckDB's
dialect so each registered query can be checked by an independent engine.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources import tables as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index_sql: str) -> str:
    return f"{sql_list(values)}[CAST(({index_sql}) % {len(values)} AS BIGINT) + 1]"


def case_map(mapping: dict, key_sql: str, default="NULL") -> str:
    arms = " ".join(f"WHEN {key_sql} = {q(k)} THEN {v if not isinstance(v, str) else q(v)}" for k, v in mapping.items())
    return f"(CASE {arms} ELSE {default} END)"


def round1(x: str) -> str:
    """Python round(x, 1) on non-negative doubles (same construction as scalars.round1)."""
    x = f"CAST(({x}) AS DOUBLE)"
    t = f"({x} * 10.0)"
    lo = f"floor({t})"
    err = f"({x} * 2.0 - (({x} * 8.0 + {x} * 2.0) - {x} * 8.0))"
    tie = (f"(CASE WHEN {err} > 0 THEN ceil({t}) WHEN {err} < 0 THEN {lo} "
           f"WHEN {lo} % 2 = 0 THEN {lo} ELSE {lo} + 1 END)")
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {t} - {lo} <> 0.5 THEN floor({t} + 0.5) / 10.0 "
            f"ELSE {tie} / 10.0 END)")


def clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def source_weight(col: str) -> str:
    low = f"lower(coalesce({col}, ''))"
    cond = " OR ".join(f"contains({low}, {q(n)})" for n in K.HIGH_VALUE_SOURCES)
    return f"(CASE WHEN {cond} THEN 'high' ELSE 'low' END)"


def source_rank(col: str) -> str:
    low = f"lower(coalesce({col}, ''))"
    arms = " ".join(f"WHEN contains({low}, {q(n)}) THEN {i}" for i, n in enumerate(K.SOURCE_CREDIBILITY_ORDER))
    return f"(CASE {arms} ELSE {len(K.SOURCE_CREDIBILITY_ORDER)} END)"


def social_score(tone: str, focus: str) -> str:
    return (f"(({case_map(K.TONE_SCORES, tone, K.UNKNOWN_LABEL_SCORE)} + "
            f"{case_map(K.FOCUS_SCORES, focus, K.UNKNOWN_LABEL_SCORE)}) / 2.0)")


WS = "[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normalize_headline(col: str) -> str:
    cut = f"regexp_replace(coalesce({col}, ''), '{WS}*-{WS}*[^-]+$', '')"
    return f"regexp_replace(lower({strip_ws(cut)}), '{WS}+', ' ', 'g')"


def iso_seconds(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S+00:00')"


def fmt1(x: str) -> str:
    return f"printf('%.1f', CAST({x} AS DOUBLE))"


AS_OF = f"TIMESTAMP '{T.AS_OF}'"
ISO_RE = "^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?)?(Z|[+-]\\d{2}:\\d{2})?$"


def lenient_timestamp(col: str) -> str:
    raw = f"trim({col})"
    rfc = f"regexp_replace({raw}, '^[A-Za-z]{{3}},\\s*', '')"
    rfc_zone = f"regexp_replace({rfc}, '\\s+(GMT|UT|UTC|Z)$', ' +0000')"
    iso = (f"CASE WHEN regexp_full_match({raw}, '{ISO_RE}') THEN "
           f"CAST(TRY_CAST({raw} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END")
    rfc_ts = (f"CAST(coalesce(try_strptime({rfc_zone}, '%d %b %Y %H:%M:%S %z'), "
              f"try_strptime({rfc_zone}, '%d %b %Y %H:%M %z')) AT TIME ZONE 'UTC' AS TIMESTAMP)")
    return f"(CASE WHEN {col} IS NULL OR {raw} = '' THEN NULL ELSE coalesce({rfc_ts}, {iso}) END)"


def iso_or_min(col: str) -> str:
    raw = f"CAST({col} AS VARCHAR)"
    return (f"coalesce(CASE WHEN regexp_full_match({raw}, '{ISO_RE}') THEN "
            f"CAST(TRY_CAST({raw} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END, TIMESTAMP '0001-01-01 00:00:00')")


def _entity(col: str) -> str:
    return f"('E' || CAST({col} % 8 AS VARCHAR))"


def binding_ctes() -> dict[str, tuple[str, list[str]]]:
    """name -> (SQL body, dependencies)."""
    roster_rows = ", ".join(
        f"({i}, {q(e)}, {T.STATIC_WEIGHTS.get(e, 'NULL')}, {q(T.APP_IDS[e]) if e in T.APP_IDS else 'NULL'})"
        for i, e in enumerate(T.ENTITIES))
    change_type = case_map(T.CHANGE_TYPE_OF_EVENT, "event_type")
    videos_type = "STRUCT(video_id VARCHAR, title VARCHAR, url VARCHAR, published_at VARCHAR, thumbnail_url VARCHAR, description VARCHAR)[]"
    pub = f"({AS_OF} - to_days(CAST(page_id % 120 AS INTEGER)) + to_hours(CAST(page_id % 24 AS BIGINT)))"
    published = (
        f"CASE WHEN page_id % 16 = 7 THEN NULL WHEN page_id % 16 = 15 THEN '' "
        f"WHEN page_id % 8 = 0 THEN strftime({pub}, '%a, %d %b %Y %H:%M:%S') || ' GMT' "
        f"WHEN page_id % 8 = 1 THEN strftime({pub} + INTERVAL 2 HOUR, '%a, %d %b %Y %H:%M:%S') || ' +0200' "
        f"WHEN page_id % 8 = 2 THEN strftime({pub}, '%Y-%m-%dT%H:%M:%SZ') "
        f"WHEN page_id % 8 = 3 THEN strftime({pub} - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00' "
        f"WHEN page_id % 8 = 4 THEN strftime({pub}, '%Y-%m-%dT%H:%M:%S') "
        f"WHEN page_id % 8 = 5 THEN strftime({pub}, '%Y-%m-%d') ELSE 'yesterday' END")
    source = pick(T.NEWS_SOURCES, "page_id")
    e_ent = _entity("user_id")
    vid_pub = iso_seconds("date_trunc('second', ts)")
    static_by_eno = case_map(T.STATIC_WEIGHTS, "'E' || CAST(eno AS VARCHAR)")
    return {
        "b_roster": (f"SELECT * FROM (VALUES {roster_rows}) t(pos, entity, static_weight, app_id)", []),
        "b_titles": ("SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, "
                     "regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages", []),
        "b_changes_core": (
            f"SELECT event_id AS id, {e_ent} AS entity, date_trunc('second', ts) AS detected_at, "
            f"{pick(T.PAGE_TYPES, 'event_id')} AS page_type, {change_type} AS change_type, "
            f"CAST(1 + CAST(floor(value) AS BIGINT) % 10 AS INTEGER) AS customer_impact_score, "
            f"{pick(K.REVENUE_SENSITIVITY_LEVELS, 'event_id')} AS revenue_sensitivity, "
            f"{pick(K.SEGMENTS_AFFECTED, 'event_id')} AS segment_affected FROM events", []),
        "b_changes": (
            "SELECT c.*, p.title AS description, p.url FROM b_changes_core c LEFT JOIN b_titles p "
            "ON c.id % (SELECT count(*) FROM pages) = p.page_id", ["b_changes_core", "b_titles"]),
        "b_offers": (
            f"SELECT event_id AS id, {e_ent} AS entity, date_trunc('second', ts) AS detected_at, "
            f"{pick(K.OFFER_TYPES, 'event_id')} AS offer_type, {pick(K.OFFER_TARGET_SEGMENTS, 'event_id')} AS target_segment, "
            f"{pick(T.AGGRESSIVENESS_BINDING, 'event_id')} AS aggressiveness, {pick(K.OFFER_DURATIONS, 'event_id')} AS duration, "
            f"{pick(K.OFFER_MATCH_VALUES, 'event_id')} AS home_match, 'offer ' || CAST(event_id AS VARCHAR) AS description "
            f"FROM events WHERE event_type IN ('purchase', 'signup')", []),
        "b_social": (
            f"SELECT event_id AS id, {e_ent} AS entity, date_trunc('second', ts) AS scanned_at, "
            f"{pick(T.TONE_BINDING, 'event_id')} AS tone_shift, {pick(T.FOCUS_BINDING, 'event_id')} AS campaign_focus, "
            f"'theme ' || CAST(event_id % 7 AS VARCHAR) AS messaging_theme, "
            f"[{pick(K.SEGMENTS_AFFECTED, 'event_id')}] AS target_segment_signals, "
            f"'opportunity ' || CAST(event_id AS VARCHAR) AS opportunity, CAST(event_id % 11 AS INTEGER) AS mention_count, "
            f"CASE WHEN event_id % 3 = 0 THEN CAST([] AS {videos_type}) ELSE CAST([{{'video_id': 'v' || CAST(event_id AS VARCHAR), "
            f"'title': 'video ' || CAST(event_id AS VARCHAR), 'url': 'https://video.example/' || CAST(event_id AS VARCHAR), "
            f"'published_at': {vid_pub}, 'thumbnail_url': '', 'description': ''}}] AS {videos_type}) END AS videos "
            f"FROM events WHERE event_type = 'view'", []),
        "b_scores": (
            f"SELECT CAST(date_diff('day', DATE '2024-01-01', day) AS BIGINT) * 10 + eno AS id, 'E' || CAST(eno AS VARCHAR) AS entity, "
            f"scanned_at, {round1(clamp('avg_value / 10.0', 1.0, 10.0))} AS threat_score, "
            f"{round1(clamp('avg_value / 8.0', 1.0, 10.0))} AS review_component, "
            f"{round1(clamp('n / 4.0', 1.0, 10.0))} AS news_component, "
            f"{round1(clamp('max_value / 50.0', 1.0, 10.0))} AS feature_velocity_component, "
            f"CAST(coalesce({static_by_eno}, {K.STATIC_DEFAULT}) AS DOUBLE) AS smb_relevance_component, "
            f"CASE WHEN n % 4 = 0 THEN NULL ELSE {round1(clamp('avg_value / 12.0', 1.0, 10.0))} END AS social_component, "
            f"CASE WHEN n % 6 = 0 THEN NULL ELSE {round1(clamp('avg_value / 15.0', 1.0, 10.0))} END AS offers_component, "
            f"CASE WHEN n % 5 = 0 THEN {q(T.UNAVAILABLE_REASON)} ELSE 'Moved on ' || CAST(n AS VARCHAR) || ' signals.' END AS reason "
            f"FROM (SELECT CAST(user_id % 8 AS INTEGER) AS eno, CAST(ts AS DATE) AS day, avg(value) AS avg_value, "
            f"max(value) AS max_value, count(*) AS n, max(date_trunc('second', ts)) AS scanned_at FROM events GROUP BY 1, 2)", []),
        "b_news": (
            f"SELECT page_id AS id, coalesce({case_map(T.LANG_ENTITY, 'lang')}, 'E4') AS entity, "
            f"title || ' - ' || {source} AS headline, {source} AS source, url, {published} AS published_at, "
            f"{AS_OF} - to_minutes(CAST(page_id % 1000 AS BIGINT)) AS fetched_at, "
            f"{pick(K.NEWS_IMPACT_TYPES, 'page_id')} AS impact_type, CAST(1 + page_id % 10 AS INTEGER) AS relevance, "
            f"{pick(K.MARKET_IMPACTS, 'page_id')} AS market_impact, title AS summary, {source_weight(source)} AS source_weight "
            f"FROM b_titles", ["b_titles"]),
        "b_reviews": (
            f"SELECT * FROM (SELECT {_entity('conv_id')} AS entity, {case_map(T.APP_IDS, _entity('conv_id'))} AS app_id, "
            f"CASE WHEN turn % 3 = 2 THEN NULL ELSE CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS review_id, "
            f"text AS content, CASE WHEN conv_id % 6 = 0 THEN NULL ELSE CAST(conv_id % 6 AS INTEGER) END AS score, "
            f"{AS_OF} - to_days(CAST(conv_id % 40 AS INTEGER)) - to_hours(CAST(turn AS BIGINT)) AS reviewed_at "
            f"FROM conversations WHERE role = 'user') WHERE app_id IS NOT NULL", []),
        "b_sentiment": (
            f"SELECT conv_id AS id, {_entity('conv_id')} AS entity, {AS_OF} - to_days(CAST(conv_id % 40 AS INTEGER)) AS scanned_at, "
            f"{pick(K.SENTIMENTS, 'conv_id')} AS sentiment, {round1(clamp('avg_len / 100.0', 1.0, 10.0))} AS severity_score, "
            f"['theme', 'turns ' || CAST(n AS VARCHAR)] AS themes, "
            f"['complaint ' || CAST(conv_id AS VARCHAR), 'slow support', 'fees'] AS top_complaints, "
            f"['praise ' || CAST(conv_id AS VARCHAR)] AS top_praise, 'opportunity ' || CAST(conv_id AS VARCHAR) AS opportunity, "
            f"CAST(n AS INTEGER) AS review_count "
            f"FROM (SELECT conv_id, count(*) AS n, avg(length(text)) AS avg_len FROM conversations GROUP BY conv_id)", []),
        "b_products": (
            f"SELECT id, entity, detected_at, url, description AS raw_change, 'move ' || CAST(id AS VARCHAR) AS move, "
            f"{pick(K.HOME_PRODUCTS, 'id')} AS home_product, "
            f"CASE WHEN id % 13 = 0 THEN NULL ELSE {pick(T.THREAT_LEVEL_BINDING, 'id')} END AS threat_level, "
            f"CASE WHEN id % 29 = 0 THEN '' WHEN id % 31 = 0 THEN ' : ' ELSE 'Review ' || change_type END AS recommended_action, "
            f"detected_at AS analyzed_at FROM b_changes WHERE page_type = 'product_updates'", ["b_changes"]),
        "b_history": (
            f"SELECT event_id AS id, {e_ent} AS entity, strftime(ts, '%Y-%m-%d') AS event_date, "
            f"{pick(T.HISTORY_TYPES, 'event_id')} AS event_type, 'event ' || CAST(event_id AS VARCHAR) AS description, "
            f"'news' || CAST(event_id % 5 AS VARCHAR) || '.example.com' AS source, CAST(5 + event_id % 4 AS INTEGER) AS impact_score "
            f"FROM events WHERE event_type = 'error'", []),
        "b_comparison": (
            f"SELECT event_id AS id, {e_ent} AS entity, {pick(K.COMPARISON_DIMENSIONS, 'event_id')} AS dimension, "
            f"{pick(K.COMPARISON_RATINGS, 'CAST(floor(value) AS BIGINT)')} AS rating, "
            f"event_type || ' ' || CAST(event_id AS VARCHAR) AS note FROM events", []),
    }


def with_ctes(sql: str, needs: list[str], extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """Prefix `sql` with the binding CTEs it needs (and their dependencies), in dependency order."""
    defs = dict(binding_ctes())
    if extra:
        defs.update(extra)
    order: list[str] = []

    def visit(name: str):
        if name in order:
            return
        for dep in defs[name][1]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS ({defs[n][0]})" for n in order)
    return f"WITH {body}\n{sql}"
