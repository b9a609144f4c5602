"""Registered queries for ingest (A1-A15) and the classification contract."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import answers as D
from ..operators import ingest as A
from ..sources import tables as T
from . import sql_bindings as B
from .registry import query

ISO = B.iso_seconds


def _raw(spark, sf_dir):
    return T.Raw(spark, sf_dir)


# ---------------------------------------------------------------------------------------------- feeds binding
FEED_SIZE = 25


def _xml_escape(c):
    out = F.coalesce(c, F.lit(""))
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _feed_items(spark, sf_dir):
    """Feed items of the binding: every news row is an item of feed (entity, id / 25); some titles
    blank (id % 13 = 0), some links repeat the previous one (id % 23 = 0), half carry a source."""
    n = T.news(_raw(spark, sf_dir))
    rid = F.col("id")
    return n.select(
        "entity", (rid / FEED_SIZE).cast("long").alias("feed_no"), "id",
        F.when(rid % 13 == 0, F.lit("")).otherwise(F.col("headline")).alias("title"),
        F.concat(F.lit("https://news.example/a/"), F.when(rid % 23 == 0, rid - 1).otherwise(rid).cast("string")).alias("link"),
        F.coalesce(F.col("published_at"), F.lit("")).alias("pub"),
        F.when(rid % 2 == 0, F.col("source")).alias("src"),
        F.col("summary"), F.col("url"))


def news_feeds(spark, sf_dir):
    items = _feed_items(spark, sf_dir)
    src = F.when(F.col("src").isNull(), F.lit("")).otherwise(
        F.concat(F.lit('<source url="https://src.example/">'), _xml_escape(F.col("src")), F.lit("</source>")))
    item = F.concat(F.lit("<item><title>"), _xml_escape(F.col("title")), F.lit("</title><link>"), _xml_escape(F.col("link")),
                    F.lit("</link><pubDate>"), _xml_escape(F.col("pub")), F.lit("</pubDate>"), src, F.lit("</item>"))
    g = items.groupBy("entity", "feed_no").agg(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).alias("xs"))
    return g.select("entity", "feed_no", F.concat(F.lit("<rss version=\"2.0\"><channel>"),
                                                  F.array_join(F.transform("xs", lambda e: e["x"]), ""),
                                                  F.lit("</channel></rss>")).alias("xml"))


def video_feeds(spark, sf_dir):
    items = _feed_items(spark, sf_dir)
    desc = F.concat_ws(" ", F.col("summary"), F.col("summary"), F.col("summary"), F.col("summary"))
    entry = F.concat(
        F.lit("<entry><yt:videoId>v"), F.col("id").cast("string"), F.lit("</yt:videoId><title>"), _xml_escape(F.col("title")),
        F.lit('</title><link rel="alternate" href="'), _xml_escape(F.col("url")), F.lit('"/><published>'), _xml_escape(F.col("pub")),
        F.lit('</published><media:group><media:thumbnail url="https://img.example/'), F.col("id").cast("string"),
        F.lit('.jpg"/><media:description>'), _xml_escape(desc), F.lit("</media:description></media:group></entry>"))
    g = items.groupBy("entity", "feed_no").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("x")))).alias("xs"))
    head = ('<feed xmlns:yt="http://www.youtube.com/xml/schemas/2015" xmlns:media="http://search.yahoo.com/mrss/" '
            'xmlns="http://www.w3.org/2005/Atom">')
    return g.select("entity", "feed_no", F.concat(F.lit(head), F.array_join(F.transform("xs", lambda e: e["x"]), ""),
                                                  F.lit("</feed>")).alias("xml"))


_ITEMS_SQL = {"items": (
    "SELECT entity, CAST(floor(id / 25) AS BIGINT) AS feed_no, id, CASE WHEN id % 13 = 0 THEN '' ELSE headline END AS title, "
    "'https://news.example/a/' || CAST(CASE WHEN id % 23 = 0 THEN id - 1 ELSE id END AS VARCHAR) AS link, "
    "coalesce(published_at, '') AS pub, CASE WHEN id % 2 = 0 THEN source END AS src, summary, url, "
    "row_number() OVER (PARTITION BY entity, CAST(floor(id / 25) AS BIGINT) ORDER BY id) - 1 AS pos FROM b_news", ["b_news"])}


def _trim_sql(x):
    return B.strip_ws(f"coalesce({x}, '')")


_FB_EXTRACT = "regexp_extract(headline, '-\\s*([^-]+)$', 1)"
_FALLBACK = (f"CASE WHEN regexp_matches(headline, '-\\s*([^-]+)$') THEN {B.strip_ws(_FB_EXTRACT)} ELSE 'Unknown' END")
_NEWS_ITEMS_SELECT = (
    f"SELECT entity, feed_no, pos, headline, url, published_at, source, rank, {B.source_weight('source')} AS source_weight FROM ("
    "SELECT *, row_number() OVER (PARTITION BY entity, feed_no ORDER BY pos) AS rank FROM ("
    f"SELECT entity, feed_no, pos, headline, url, published_at, CASE WHEN srct <> '' THEN srct ELSE {_FALLBACK} END AS source, "
    "row_number() OVER (PARTITION BY entity, feed_no, url ORDER BY pos) AS k FROM ("
    f"SELECT entity, feed_no, pos, {_trim_sql('title')} AS headline, {_trim_sql('link')} AS url, {_trim_sql('pub')} AS published_at, "
    f"{_trim_sql('src')} AS srct FROM items) WHERE headline <> '' AND url <> '') WHERE k = 1) WHERE rank <= 20")


def _news_items_sql() -> str:
    return B.with_ctes(_NEWS_ITEMS_SELECT, ["items"], _ITEMS_SQL)


@query("a3_parse_news_feed", _news_items_sql())
def a3_parse_news_feed(spark, sf_dir):
    return A.parse_news_feed(news_feeds(spark, sf_dir)).select(
        "entity", "feed_no", "pos", "headline", "url", "published_at", "source", "rank", "source_weight")


@query("a4_parse_mention_feed", B.with_ctes(
    f"SELECT entity, feed_no, pos, {_trim_sql('title')} AS headline, {_trim_sql('link')} AS url, {_trim_sql('pub')} AS published_at "
    f"FROM items WHERE pos < {K.MENTIONS_PER_FEED} AND {_trim_sql('title')} <> '' AND {_trim_sql('link')} <> ''", ["items"], _ITEMS_SQL))
def a4_parse_mention_feed(spark, sf_dir):
    return A.parse_mention_feed(news_feeds(spark, sf_dir)).select("entity", "feed_no", "pos", "headline", "url", "published_at")


def _video_sql() -> str:
    inner = _trim_sql("concat_ws(' ', summary, summary, summary, summary)")
    d = f"replace({inner}, chr(10), ' ')"
    short = (f"CASE WHEN length({d}) > {K.VIDEO_DESCRIPTION_MAX} THEN regexp_replace(substr({d}, 1, {K.VIDEO_DESCRIPTION_MAX}), "
             f"' [^ ]*$', '') || '…' ELSE {d} END")
    sql = (f"SELECT entity, feed_no, pos, 'v' || CAST(id AS VARCHAR) AS video_id, {_trim_sql('title')} AS title, url, "
           f"{_trim_sql('pub')} AS published_at, 'https://img.example/' || CAST(id AS VARCHAR) || '.jpg' AS thumbnail_url, "
           f"CASE WHEN {d} = '' THEN '' ELSE {short} END AS description FROM items "
           f"WHERE pos < {K.VIDEOS_PER_FEED} AND {_trim_sql('title')} <> ''")
    return B.with_ctes(sql, ["items"], _ITEMS_SQL)


@query("a5_parse_video_feed", _video_sql())
def a5_parse_video_feed(spark, sf_dir):
    return A.parse_video_feed(video_feeds(spark, sf_dir)).select(
        "entity", "feed_no", "pos", "video_id", "title", "url", "published_at", "thumbnail_url", "description")


@query("a6_canonical_id", "SELECT page_id, CASE WHEN h <> '' AND starts_with(s, 'UC') THEN s END AS channel_id, "
                          "CASE WHEN h = '' THEN 'no_canonical' WHEN starts_with(s, 'UC') THEN 'ok' ELSE 'unexpected' END AS channel_status "
                          "FROM (SELECT page_id, h, CASE WHEN h = '' THEN '' ELSE regexp_extract(h, '([^/]*)$', 1) END AS s FROM "
                          "(SELECT page_id, regexp_extract(CASE page_id % 4 WHEN 0 THEN '' ELSE '<link rel=\"canonical\" href=\"' || "
                          "CASE page_id % 4 WHEN 1 THEN 'https://video.example/channel/UC' || md5(url) WHEN 2 THEN 'https://video.example/c/' "
                          "|| CAST(page_id AS VARCHAR) ELSE 'UC' || CAST(page_id AS VARCHAR) END || '\">' END || html, "
                          "'<link rel=\"canonical\" href=\"([^\"]+)\"', 1) AS h FROM pages))")
def a6_canonical_id(spark, sf_dir):
    """Every page with a canonical link put in front: a channel's, another path's, a bare id's, or none."""
    pages, n = _raw(spark, sf_dir).table("pages"), F.col("page_id")
    href = (F.when(n % 4 == 1, F.concat(F.lit("https://video.example/channel/UC"), F.md5(F.col("url").cast("binary"))))
            .when(n % 4 == 2, F.concat(F.lit("https://video.example/c/"), n.cast("string"))).otherwise(F.concat(F.lit("UC"), n.cast("string"))))
    link = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit('<link rel="canonical" href="'), href, F.lit('">')))
    return A.canonical_id(pages.withColumn("html", F.concat(link, "html"))).select("page_id", "channel_id", "channel_status")


# ---------------------------------------------------------------------------------------------- A1 / A2
@query("a1_conform_offers", B.with_ctes(
    "SELECT id, array_to_string(list_filter([CASE WHEN NOT aggressiveness IN ('High', 'Medium', 'Low') THEN 'enum:aggressiveness' END, "
    "CASE WHEN NOT offer_type IN ('free_trial', 'hardware_discount', 'fee_waiver', 'cashback', 'bundle', 'rate_reduction') "
    "THEN 'enum:offer_type' END], lambda x: x IS NOT NULL), ',') AS reasons FROM b_offers "
    "WHERE NOT aggressiveness IN ('High', 'Medium', 'Low')", ["b_offers"]))
def a1_conform_offers(spark, sf_dir):
    _, bad = A.conform(T.offers(_raw(spark, sf_dir)), not_null=("entity", "detected_at"),
                       enums={"aggressiveness": K.OFFER_AGGRESSIVENESS_LEVELS, "offer_type": K.OFFER_TYPES})
    return bad.select("id", F.array_join("reasons", ",").alias("reasons"))


@query("a2_watch_pages", B.with_ctes(
    f"SELECT entity, layer, page_key, url FROM (SELECT coalesce({B.case_map(T.LANG_ENTITY, 'lang')}, 'E4') AS entity, "
    f"{B.pick(T.LAYERS, 'page_id')} AS layer, page_id, url FROM b_titles) t, "
    "LATERAL (SELECT (CASE layer WHEN 'update' THEN 'product_updates::' WHEN 'offer' THEN 'offers::' ELSE '' END) "
    "|| 'p' || CAST(page_id AS VARCHAR) AS page_key)", ["b_titles"]))
def a2_watch_pages(spark, sf_dir):
    w = T.watched_pages(_raw(spark, sf_dir))
    rosters = w.select("entity", "layer", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("label"), "url")
    return A.watch_pages(rosters).select("entity", "layer", "page_key", "url")


# ---------------------------------------------------------------------------------------------- A7 / A8
_REVIEWS_SELECT = (
    "SELECT entity, app_id, coalesce(review_id, 'gp_' || app_id || '_' || CAST(row_number() OVER "
    "(PARTITION BY app_id ORDER BY r) - 1 AS VARCHAR)) AS id, substr(body, 1, 600) AS body, "
    "CAST(coalesce(score, 0) AS INTEGER) AS rating, coalesce(strftime(reviewed_at, '%Y-%m-%d'), '') AS date, r AS feed_pos "
    "FROM (SELECT *, " + B.strip_ws("coalesce(content, '')") + " AS body FROM (SELECT *, row_number() OVER (PARTITION BY app_id "
    "ORDER BY reviewed_at DESC NULLS LAST, review_id DESC NULLS LAST, content DESC NULLS LAST) AS r FROM b_reviews) WHERE r <= 20) "
    "WHERE body <> ''")


def _reviews_sql() -> str:
    return B.with_ctes(_REVIEWS_SELECT, ["b_reviews"])


@query("a7_normalize_reviews", _reviews_sql())
def a7_normalize_reviews(spark, sf_dir):
    return A.normalize_reviews(T.reviews(_raw(spark, sf_dir)))


_OVERRIDES = [("E1", "E1 instant transfers"), ("E4", "E4 card terminals & tills")]


@query("a8_feed_query", B.with_ctes(
    "SELECT e.entity, coalesce(o.query, e.entity || ' payments Canada') AS query, "
    f"'{A.FEED_BASE}?q=' || replace(url_encode(coalesce(o.query, e.entity || ' payments Canada')), '%2F', '/') "
    "|| '&hl=en-CA&gl=CA&ceid=CA:en' AS feed_url FROM (SELECT DISTINCT entity FROM b_changes_core) e "
    "LEFT JOIN (VALUES " + ", ".join(f"({B.q(a)}, {B.q(b)})" for a, b in _OVERRIDES) + ") o(entity, query) ON o.entity = e.entity",
    ["b_changes_core"]))
def a8_feed_query(spark, sf_dir):
    ents = T.changes(_raw(spark, sf_dir), with_text=False).select("entity").distinct()
    ov = T.literal_table(spark, _OVERRIDES, "entity string, query string")
    return A.feed_query(ents, ov)


# ---------------------------------------------------------------------------------------------- A9 - A15
_SPLIT = "2024-01-20 00:00:00"


@query("a9_append_rows", B.with_ctes(
    "SELECT id, entity, social_component, offers_component FROM b_scores WHERE scanned_at < TIMESTAMP '" + _SPLIT + "' "
    "UNION ALL SELECT (SELECT max(id) FROM b_scores WHERE scanned_at < TIMESTAMP '" + _SPLIT + "') + row_number() OVER "
    f"(ORDER BY scanned_at, entity) AS id, entity, coalesce(social_component, {K.SOCIAL_BASELINE}) AS social_component, "
    f"coalesce(offers_component, {K.OFFERS_BASELINE}) AS offers_component FROM b_scores WHERE scanned_at >= TIMESTAMP '" + _SPLIT + "'",
    ["b_scores"]))
def a9_append_rows(spark, sf_dir):
    sc = T.scores(_raw(spark, sf_dir)).select("id", "entity", "scanned_at", "social_component", "offers_component")
    cut = F.lit(_SPLIT).cast("timestamp")
    cur = sc.filter(F.col("scanned_at") < cut)
    new = sc.filter(F.col("scanned_at") >= cut).withColumn("id", F.lit(None).cast("long"))
    out = A.append_rows(cur, new, {"social_component": K.SOCIAL_BASELINE, "offers_component": K.OFFERS_BASELINE},
                        [F.col("scanned_at"), F.col("entity")])
    return out.select("id", "entity", "social_component", "offers_component")


def _snap_rows(spark, sf_dir):
    w = T.watched_pages(_raw(spark, sf_dir))
    return w.select("entity", "page_key", "page_id", "html")


@query("a10_upsert_snapshots", B.with_ctes(
    "SELECT entity, page_key, content_hash, text_len, updated_at FROM ("
    "SELECT *, row_number() OVER (PARTITION BY entity, page_key ORDER BY src DESC, updated_at DESC) AS r FROM ("
    "SELECT entity, page_key, sha256(html) AS content_hash, length(html) AS text_len, 'v1' AS updated_at, 0 AS src "
    "FROM w UNION ALL "
    "SELECT entity, CASE page_id % 3 WHEN 0 THEN page_key ELSE page_key || '::new' END AS page_key, sha256(html || repeat(html, 40)) "
    "AS content_hash, least(length(html) * 41, 200000) AS text_len, 'v2' AS updated_at, 1 AS src FROM w)) WHERE r = 1",
    ["w"], {"w": (f"SELECT coalesce({B.case_map(T.LANG_ENTITY, 'lang')}, 'E4') AS entity, "
                  f"(CASE {B.pick(T.LAYERS, 't.page_id')} WHEN 'update' THEN 'product_updates::' WHEN 'offer' THEN 'offers::' ELSE '' END) "
                  "|| 'p' || CAST(t.page_id AS VARCHAR) AS page_key, t.page_id, p.html FROM b_titles t JOIN pages p ON p.page_id = t.page_id",
                  ["b_titles"])}))
def a10_upsert_snapshots(spark, sf_dir):
    """Snapshots of all pages, and an update of every page with a long new text (the page repeated 41 times), for
    every third under its own key, else under a new one: the stored text is cut to 200,000 characters, the
    hash covers the full text."""
    s = _snap_rows(spark, sf_dir)
    cur = s.select("entity", "page_key", F.col("html").alias("content_text"), S.content_hash(F.col("html")).alias("content_hash"),
                   F.lit("v1").alias("updated_at"))
    full = F.concat(F.col("html"), F.repeat(F.col("html"), 40))
    key = F.when(F.col("page_id") % 3 == 0, F.col("page_key")).otherwise(F.concat("page_key", F.lit("::new")))
    upd = s.select("entity", key.alias("page_key"), full.alias("content_text"), S.content_hash(full).alias("content_hash"),
                   F.lit("v2").alias("updated_at"))
    out = A.upsert(cur, upd, ["entity", "page_key"])
    return out.select("entity", "page_key", "content_hash", F.length("content_text").cast("long").alias("text_len"), "updated_at")


@query("a11_insert_ignore", B.with_ctes(
    "SELECT id, entity, url FROM (SELECT *, row_number() OVER (PARTITION BY entity, link ORDER BY id) AS r FROM "
    "(SELECT id, entity, 'https://news.example/a/' || CAST(id % 200 AS VARCHAR) AS link, url FROM b_news)) n "
    "WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT entity, 'https://news.example/a/' || CAST(id % 200 AS VARCHAR) AS link "
    "FROM b_news WHERE id % 3 = 0) c WHERE c.entity = n.entity AND c.link = n.link)", ["b_news"]))
def a11_insert_ignore(spark, sf_dir):
    """Every news row re-offered as a batch against the stored third (key entity + canonical link)."""
    n = T.news(_raw(spark, sf_dir)).select(
        "id", "entity", "url", F.concat(F.lit("https://news.example/a/"), (F.col("id") % 200).cast("string")).alias("link"))
    stored = n.filter(F.col("id") % 3 == 0)
    return A.insert_ignore(stored, n, ["entity", "link"], [F.col("id")]).select("id", "entity", "url")


def _moved_sql(table: str, columns: str) -> str:
    return f"(SELECT CASE id % 5 WHEN 0 THEN 'E8' WHEN 1 THEN 'E9' ELSE entity END AS entity, {columns} FROM {table})"


def _moved(df):
    """All rows, a part of them given to E8 and E9, which own none so far."""
    return df.withColumn("entity", F.when(F.col("id") % 5 == 0, "E8").when(F.col("id") % 5 == 1, "E9").otherwise(F.col("entity")))


@query("a12_backfill", B.with_ctes(
    "SELECT id, entity, 'current' AS origin FROM b_changes_core UNION ALL "
    f"SELECT id, entity, 'seed' AS origin FROM {_moved_sql('b_history', 'id')} WHERE entity NOT IN "
    "(SELECT DISTINCT entity FROM b_changes_core)", ["b_changes_core", "b_history"]))
def a12_backfill(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    cur = T.changes(raw, with_text=False).select("id", "entity", F.lit("current").alias("origin"))
    return A.backfill(cur, _moved(T.history(raw)).select("id", "entity", F.lit("seed").alias("origin")))


@query("a12_backfill_if_empty", B.with_ctes(
    "SELECT id, entity, 'seed' AS origin, 'empty' AS stored FROM b_history UNION ALL "
    "SELECT id, entity, 'current', 'filled' FROM b_changes_core", ["b_history", "b_changes_core"]))
def a12_backfill_if_empty(spark, sf_dir):
    """All history rows against a table without rows, and against the changes (which stay as they are)."""
    raw = _raw(spark, sf_dir)
    seed = T.history(raw).select("id", "entity", F.lit("seed").alias("origin"))
    filled = T.changes(raw, with_text=False).select("id", "entity", F.lit("current").alias("origin"))
    empty = spark.createDataFrame([], seed.schema)
    return A.backfill(empty, seed, only_if_empty=True).withColumn("stored", F.lit("empty")).unionByName(
        A.backfill(filled, seed, only_if_empty=True).withColumn("stored", F.lit("filled")))


def _bootstrap(spark, sf_dir):
    """E8 and E9 own history and seed changes, but neither scores nor changes; E0 owns both."""
    raw = _raw(spark, sf_dir)
    changes = T.changes(raw, with_text=False)
    return A.bootstrap_entities(_moved(T.history(raw)), _moved(changes), T.scores(raw), changes, ["E0", "E8", "E9"],
                                T.roster(spark).select("entity", "static_weight"))


_HISTORY = "id, event_date, event_type, description, source, impact_score"


@query("a13_bootstrap_scores", B.with_ctes(
    "SELECT h.entity, CAST(h.impact_score AS DOUBLE) AS threat_score, "
    f"CAST(coalesce(r.static_weight, {K.STATIC_DEFAULT}) AS DOUBLE) AS smb_relevance_component, "
    "h.event_date || ': ' || h.description || ' (' || h.source || ')' AS reason, h.event_date || 'T00:00:00+00:00' AS scanned_at, "
    f"h.id AS event_id FROM {_moved_sql('b_history', _HISTORY)} h LEFT JOIN b_roster r ON r.entity = h.entity "
    "WHERE h.entity IN ('E0', 'E8', 'E9') AND h.entity NOT IN (SELECT entity FROM b_scores)",
    ["b_history", "b_roster", "b_scores"]))
def a13_bootstrap_scores(spark, sf_dir):
    _, out, _ = _bootstrap(spark, sf_dir)
    return out.select("entity", "threat_score", "smb_relevance_component", "reason", "scanned_at", "event_id")


@query("a13_bootstrap_events", B.with_ctes(
    f"SELECT entity, {_HISTORY} FROM {_moved_sql('b_history', _HISTORY)} "
    "WHERE entity IN ('E0', 'E8', 'E9') AND entity NOT IN (SELECT entity FROM b_scores)", ["b_history", "b_scores"]))
def a13_bootstrap_events(spark, sf_dir):
    return _bootstrap(spark, sf_dir)[0].select("entity", *_HISTORY.split(", "))


@query("a13_bootstrap_changes", B.with_ctes(
    f"SELECT entity, id, change_type, customer_impact_score FROM {_moved_sql('b_changes_core', 'id, change_type, customer_impact_score')} "
    "WHERE entity IN ('E0', 'E8', 'E9') AND entity NOT IN (SELECT entity FROM b_changes_core)", ["b_changes_core"]))
def a13_bootstrap_changes(spark, sf_dir):
    return _bootstrap(spark, sf_dir)[2].select("entity", "id", "change_type", "customer_impact_score")


@query("a14_bulk_load", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN (value IS NOT NULL AND TRY_CAST(value AS DECIMAL(4,2)) IS NULL) "
                        "OR (props IS NOT NULL AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL) THEN 'failed' ELSE 'ok' END AS status "
                        "FROM events) GROUP BY status")
def a14_bulk_load(spark, sf_dir):
    ev = _raw(spark, sf_dir).table("events").select("event_id", "ts", "value", F.get_json_object("props", "$.k").alias("k"))
    _, counts = A.bulk_load(ev, {"event_id": "long", "ts": "timestamp", "value": "decimal(4,2)", "k": "int"})
    return counts


def _ledger(spark, sf_dir):
    """A scan run for each day of events; every error event is an error of its run, and each seventh day of a month
    is still running."""
    ev = _raw(spark, sf_dir).table("events")
    runs = ev.select(F.to_date("ts").alias("run_id")).distinct().withColumns({
        "started": F.concat(F.date_format("run_id", "yyyy-MM-dd"), F.lit("T00:00:00+00:00")),
        "finished": F.concat(F.date_format("run_id", "yyyy-MM-dd"), F.lit("T23:59:59+00:00"))})
    errors = ev.filter(F.col("event_type") == "error").select(
        F.to_date("ts").alias("run_id"), "event_id", F.concat(
            F.lit("E"), (F.col("user_id") % 8).cast("string"), F.lit(": scan failed ("), F.col("event_id").cast("string"), F.lit(")")).alias("error"))
    return A.ledger_rows(runs, "start", "started").unionByName(
        A.ledger_rows(runs.where(F.dayofmonth("run_id") % 7 != 0), "finish", "finished")).unionByName(
        A.ledger_rows(errors, "error", seq="event_id", text="error"))


_ERRORS_SQL = {"errs": ("SELECT CAST(ts AS DATE) AS run_id, event_id, 'E' || CAST(user_id % 8 AS VARCHAR) || ': scan failed (' || "
                        "CAST(event_id AS VARCHAR) || ')' AS error, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS no "
                        "FROM events WHERE event_type = 'error'", [])}


@query("a15_run_ledger", B.with_ctes(
    "SELECT r.run_id, strftime(r.run_id, '%Y-%m-%d') || 'T00:00:00+00:00' AS started_at, CASE WHEN day(r.run_id) % 7 <> 0 "
    "THEN strftime(r.run_id, '%Y-%m-%d') || 'T23:59:59+00:00' END AS finished_at, CASE WHEN day(r.run_id) % 7 = 0 THEN 'running' "
    "WHEN e.n IS NULL THEN 'completed' ELSE 'completed_with_errors' END AS status, coalesce(e.n, 0) AS n_errors "
    "FROM (SELECT DISTINCT CAST(ts AS DATE) AS run_id FROM events) r LEFT JOIN (SELECT run_id, count(*) AS n FROM errs GROUP BY 1) e "
    "ON e.run_id = r.run_id", ["errs"], _ERRORS_SQL))
def a15_run_ledger(spark, sf_dir):
    return A.run_states(_ledger(spark, sf_dir))


@query("a15_run_errors", B.with_ctes("SELECT run_id, no, error FROM errs", ["errs"], _ERRORS_SQL))
def a15_run_errors(spark, sf_dir):
    return A.run_errors(_ledger(spark, sf_dir))


@query("a15_error_texts", B.with_ctes(
    f"SELECT run_id, (no - 1) // {A.ERRORS_PER_CHUNK} AS chunk, string_agg(error, '; ' ORDER BY no) AS details FROM errs GROUP BY 1, 2",
    ["errs"], _ERRORS_SQL))
def a15_error_texts(spark, sf_dir):
    return A.error_texts(_ledger(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- D1 - D6
@query("d1_news_request", B.with_ctes(
    "SELECT entity, feed_no, string_agg(CAST(rank AS VARCHAR) || '. \"' || headline || '\" - source: ' || source || ' (' "
    "|| source_weight || '-credibility), published: ' || published_at, chr(10) ORDER BY rank) AS request FROM parsed GROUP BY 1, 2",
    ["parsed"], {"parsed": (_NEWS_ITEMS_SELECT, ["items"]), **_ITEMS_SQL}))
def d1_news_request(spark, sf_dir):
    items = A.parse_news_feed(news_feeds(spark, sf_dir)).withColumn("pos", F.col("rank"))
    return D.build_news_request(items.withColumn("batch", F.struct("entity", "feed_no")), "batch").select(
        "batch.entity", "batch.feed_no", "request")


@query("d1_review_request", B.with_ctes(
    "SELECT app_id, string_agg('[' || CAST(rating AS VARCHAR) || '/5 stars | ' || date || ']' || chr(10) || body, "
    "chr(10) || '---' || chr(10) ORDER BY feed_pos) AS request FROM (" + _REVIEWS_SELECT + ") GROUP BY app_id",
    ["b_reviews"]))
def d1_review_request(spark, sf_dir):
    rv = A.normalize_reviews(T.reviews(_raw(spark, sf_dir)))
    return D.build_review_request(rv, "app_id")


def _answers(spark, sf_dir):
    """Change answers of the binding with planted faults: %17 truncated JSON, %19 unknown enum,
    %23 score out of range (clamped), %29 blank description, %31 extra key, %37 missing field."""
    ev = _raw(spark, sf_dir).table("events")
    rid = F.col("event_id")
    ct = F.when(rid % 19 == 0, F.lit("Pricing!")).otherwise(T._pick(K.CHANGE_TYPES, rid))
    score = F.when(rid % 23 == 0, F.when(rid % 2 == 0, F.lit(0)).otherwise(F.lit(11))).otherwise(
        (F.lit(1) + F.floor("value").cast("long") % 10).cast("int"))
    desc = F.when(rid % 29 == 0, F.lit(" : ")).otherwise(F.concat(F.lit("change "), rid.cast("string")))
    fields = [ct.alias("change_type"), desc.alias("description"), score.alias("customer_impact_score"),
              T._pick(K.REVENUE_SENSITIVITY_LEVELS, rid).alias("revenue_sensitivity")]
    full = F.to_json(F.struct(*fields, T._pick(K.SEGMENTS_AFFECTED, rid).alias("segment_affected")))
    extra = F.to_json(F.struct(*fields, T._pick(K.SEGMENTS_AFFECTED, rid).alias("segment_affected"), F.lit(1).alias("note")))
    missing = F.to_json(F.struct(*fields))
    js = (F.when(rid % 17 == 0, F.substring(full, 1, 20)).when(rid % 31 == 0, extra).when(rid % 37 == 0, missing).otherwise(full))
    return ev.select(rid.alias("id"), js.alias("answer"))


def _answers_sql() -> str:
    ct = f"CASE WHEN event_id % 19 = 0 THEN 'Pricing!' ELSE {B.pick(K.CHANGE_TYPES, 'event_id')} END"
    score = ("CASE WHEN event_id % 23 = 0 THEN (CASE WHEN event_id % 2 = 0 THEN 0 ELSE 11 END) "
             "ELSE CAST(1 + CAST(floor(value) AS BIGINT) % 10 AS INTEGER) END")
    desc = "CASE WHEN event_id % 29 = 0 THEN ' : ' ELSE 'change ' || CAST(event_id AS VARCHAR) END"
    rs = B.pick(K.REVENUE_SENSITIVITY_LEVELS, "event_id")
    seg = B.pick(K.SEGMENTS_AFFECTED, "event_id")
    return (f"SELECT event_id AS id, {ct} AS change_type, {desc} AS description, {score} AS customer_impact_score, "
            f"{rs} AS revenue_sensitivity, CASE WHEN event_id % 17 <> 0 AND event_id % 31 <> 0 AND event_id % 37 = 0 THEN NULL ELSE {seg} END "
            "AS segment_affected, event_id % 17 = 0 AS truncated, event_id % 17 <> 0 AND event_id % 31 = 0 AS extra FROM events")


def _parse_sql() -> str:
    enum_ct = B.sql_list(K.CHANGE_TYPES)
    reasons = ("array_to_string(list_filter([CASE WHEN truncated THEN 'invalid_json' END, "
               f"CASE WHEN NOT truncated AND NOT list_contains({enum_ct}, change_type) THEN 'enum:change_type' END, "
               "CASE WHEN NOT truncated AND segment_affected IS NULL THEN 'missing:segment_affected' END, "
               "CASE WHEN extra THEN 'extra:note' END], lambda x: x IS NOT NULL), ',')")
    return (f"SELECT id, {reasons} AS reasons, CASE WHEN {reasons} = '' THEN greatest(1, least(10, customer_impact_score)) END AS impact, "
            f"CASE WHEN {reasons} = '' THEN change_type END AS change_type FROM ({_answers_sql()})")


@query("d2_parse_answers", _parse_sql())
def d2_parse_answers(spark, sf_dir):
    p = D.parse_answers(_answers(spark, sf_dir), D.CHANGE_ANSWER)
    ok = F.size("reasons") == 0
    return p.select("id", F.array_join("reasons", ",").alias("reasons"),
                    F.when(ok, D.clamp_score(F.col("customer_impact_score"))).alias("impact"),
                    F.when(ok, F.col("change_type")).alias("change_type"))


def _align_inputs(spark, sf_dir):
    items = A.parse_news_feed(news_feeds(spark, sf_dir))
    return items.select(F.concat_ws("-", "entity", F.col("feed_no").cast("string")).alias("batch_id"),
                        F.col("rank").alias("pos"), "headline")


@query("d4_align_answers", B.with_ctes(
    f"SELECT i.entity || '-' || CAST(i.feed_no AS VARCHAR) AS batch_id, i.rank AS pos, i.headline, "
    f"CASE WHEN i.rank % 7 = 0 THEN 'other' ELSE {B.pick(K.NEWS_IMPACT_TYPES, 'i.rank')} END AS impact_type, "
    "CAST(CASE WHEN i.rank % 7 = 0 THEN 1 ELSE greatest(1, least(10, i.rank - 3)) END AS INTEGER) AS relevance, "
    "CASE WHEN i.rank % 7 = 0 THEN 'low' ELSE 'medium' END AS market_impact, "
    "CASE WHEN i.rank % 7 = 0 THEN '' ELSE 'summary ' || CAST(i.rank AS VARCHAR) END AS summary FROM parsed i",
    ["parsed"], {"parsed": (_NEWS_ITEMS_SELECT, ["items"]), **_ITEMS_SQL}))
def d4_align_answers(spark, sf_dir):
    """Answers per batch: one per input position except every 7th (padded), plus three extra ones."""
    inputs = _align_inputs(spark, sf_dir)
    batches = inputs.groupBy("batch_id").agg(F.max("pos").alias("n"))
    answers = batches.select("batch_id", F.explode(F.sequence(F.lit(1), F.col("n") + 3)).alias("pos")).filter(
        F.col("pos") % 7 != 0).select(
        "batch_id", "pos", T._pick(K.NEWS_IMPACT_TYPES, F.col("pos")).alias("impact_type"),
        (F.col("pos") - 3).alias("relevance"), F.lit("medium").alias("market_impact"),
        F.concat(F.lit("summary "), F.col("pos").cast("string")).alias("summary"))
    return D.align_answers(inputs, answers)


@query("d5_repair_blank", B.with_ctes(
    "SELECT id, CASE WHEN NOT regexp_matches(coalesce(recommended_action, ''), '[A-Za-z0-9]') THEN "
    f"(CASE WHEN home_product = {B.q(K.GAP_LABEL)} THEN 'Evaluate whether the home side should build or partner to close this gap, given the ' "
    "|| lower(coalesce(threat_level, 'Medium')) || ' threat level.' ELSE 'Have the ' || home_product || "
    "' team review this change and assess a response, given the ' || lower(coalesce(threat_level, 'Medium')) || ' threat level.' END) "
    "ELSE recommended_action END AS recommended_action FROM b_products", ["b_products"]))
def d5_repair_blank(spark, sf_dir):
    return D.repair_blank(T.products(_raw(spark, sf_dir))).select("id", "recommended_action")


@query("d6_default_sentiment", B.with_ctes(
    "SELECT r.entity, coalesce(c.n, 0) AS review_count, coalesce(a.sentiment, 'neutral') AS sentiment, "
    f"CASE WHEN a.sentiment IS NULL THEN {K.REVIEW_BASELINE} ELSE {B.round1(B.clamp('a.severity_score', 1.0, 10.0))} END AS severity_score, "
    "CASE WHEN a.sentiment IS NULL THEN NULL ELSE a.opportunity END AS opp, "
    "CASE WHEN a.sentiment IS NOT NULL THEN a.opportunity WHEN coalesce(c.n, 0) > 0 THEN 'Found ' || CAST(c.n AS VARCHAR) || "
    "' app review(s) but the analysis failed this scan.' ELSE 'No app reviews found for this entity in this scan.' END AS opportunity "
    "FROM b_roster r LEFT JOIN (SELECT entity, count(*) AS n FROM (SELECT entity FROM b_reviews UNION ALL SELECT 'E8' FROM conversations "
    "WHERE role = 'system') GROUP BY entity) c ON c.entity = r.entity "
    "LEFT JOIN (SELECT entity, arg_max(sentiment, id) AS sentiment, arg_max(severity_score, id) AS severity_score, "
    "arg_max(opportunity, id) AS opportunity FROM b_sentiment GROUP BY entity) a ON a.entity = r.entity",
    ["b_roster", "b_reviews", "b_sentiment"]).replace(
        "CASE WHEN a.sentiment IS NULL THEN NULL ELSE a.opportunity END AS opp, ", ""))
def d6_default_sentiment(spark, sf_dir):
    """E8 owns the system turns as reviews, and no analysis of them; other entities own analyses without reviews."""
    raw = _raw(spark, sf_dir)
    system = raw.table("conversations").filter(F.col("role") == "system").select(F.lit("E8").alias("entity"))
    counts = T.reviews(raw).select("entity").union(system).groupBy("entity").agg(F.count(F.lit(1)).alias("review_count"))
    latest = T.sentiment(raw)
    w = Window.partitionBy("entity").orderBy(F.col("id").desc())
    ans = latest.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "entity", "sentiment", "severity_score", "themes", "opportunity")
    out = D.default_sentiment(T.roster(spark).select("entity"), counts, ans)
    return out.select("entity", "review_count", "sentiment", "severity_score", "opportunity")


@query("d3_clamp_severity", B.with_ctes(
    f"SELECT id, {B.round1(B.clamp('severity_score * 1.37 - 2.0', 1.0, 10.0))} AS severity FROM b_sentiment", ["b_sentiment"]))
def d3_clamp_severity(spark, sf_dir):
    """Severity answers stretched outside 1..10 (x * 1.37 - 2), clamped and rounded as the contract does."""
    s = T.sentiment(_raw(spark, sf_dir))
    return s.select("id", D.clamp_severity(F.col("severity_score") * 1.37 - 2.0).alias("severity"))


@query("d1_social_request", B.with_ctes(
    "SELECT f.entity, f.feed_no, coalesce(m.l, '(no results)') AS mention_lines, coalesce(v.l, '(no results)') AS video_lines "
    "FROM (SELECT DISTINCT entity, feed_no FROM items UNION ALL SELECT 'E8', 0) f "
    "LEFT JOIN (SELECT entity, feed_no, string_agg('- ' || headline, chr(10) ORDER BY pos) AS l FROM mentions GROUP BY 1, 2) m "
    "ON m.entity = f.entity AND m.feed_no = f.feed_no "
    "LEFT JOIN (SELECT entity, feed_no, string_agg('- ' || title, chr(10) ORDER BY pos) AS l FROM videos GROUP BY 1, 2) v "
    "ON v.entity = f.entity AND v.feed_no = f.feed_no",
    ["items", "mentions", "videos"],
    {**_ITEMS_SQL,
     "mentions": (f"SELECT entity, feed_no, pos, {_trim_sql('title')} AS headline FROM items WHERE pos < {K.MENTIONS_PER_FEED} "
                  f"AND {_trim_sql('title')} <> '' AND {_trim_sql('link')} <> ''", ["items"]),
     "videos": (f"SELECT entity, feed_no, pos, {_trim_sql('title')} AS title FROM items WHERE pos < {K.VIDEOS_PER_FEED} "
                f"AND {_trim_sql('title')} <> ''", ["items"])}))
def d1_social_request(spark, sf_dir):
    """Social request text per feed batch; E8 has no feed at all, so its parts read '(no results)'."""
    feeds = news_feeds(spark, sf_dir)
    m, v = A.parse_mention_feed(feeds), A.parse_video_feed(video_feeds(spark, sf_dir))
    batch = F.struct("entity", "feed_no")
    asked = feeds.select("entity", "feed_no")
    asked = asked.unionByName(T.literal_table(spark, [("E8", 0)], "entity string, feed_no int").select(
        "entity", F.col("feed_no").cast(asked.schema["feed_no"].dataType)))
    out = D.build_social_request(asked.select(batch.alias("batch")), m.select(batch.alias("batch"), "pos", F.col("headline").alias("text")),
                                 v.select(batch.alias("batch"), "pos", F.col("title").alias("text")))
    return out.select("batch.entity", "batch.feed_no", "mention_lines", "video_lines")
