"""Sources, ingest and keyed mutations.

No table format with in-place updates is installed, so every mutation is a pure function
old DataFrame -> new DataFrame; callers persist the result as a fresh versioned directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..session import cut_lineage
from .ordering import numbered

# --------------------------------------------------------------------------------------------
# A1: schema conformance
# --------------------------------------------------------------------------------------------


def conform(df: DataFrame, not_null=(), enums: dict | None = None, ranges: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejected) with the list of failed checks per rejected row."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in not_null]
    for c, allowed in (enums or {}).items():
        checks.append(F.when(F.col(c).isNull() | ~F.col(c).isin(*allowed), F.lit(f"enum:{c}")))
    for c, (lo, hi) in (ranges or {}).items():
        checks.append(F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi), F.lit(f"range:{c}")))
    tagged = df.withColumn("reasons", F.array_compact(F.array(*checks)))
    return (tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0))


# --------------------------------------------------------------------------------------------
# A2: watch roster
# --------------------------------------------------------------------------------------------

LAYER_PREFIX = {"page": "", "update": "product_updates::", "offer": "offers::"}


def watch_pages(rosters: DataFrame) -> DataFrame:
    """Key the pages of each (entity, layer) by the layered snapshot key, so one snapshot table holds
    the three layers. rosters: entity, layer, label, url, one row per page."""
    prefix = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in LAYER_PREFIX.items()], F.lit(""))
    return rosters.select("entity", "layer", "label", F.concat(prefix, F.col("label")).alias("page_key"), "url")


# --------------------------------------------------------------------------------------------
# feeds
# --------------------------------------------------------------------------------------------

NEWS_FEED_SCHEMA = ("channel struct<item: array<struct<title: string, link: string, pubDate: string, "
                    "source: struct<_VALUE: string, _url: string>>>>")
ATOM_FEED_SCHEMA = ("entry array<struct<videoId: string, title: string, link: struct<_href: string>, "
                    "published: string, group: struct<thumbnail: struct<_url: string>, description: string>>>")


def _trim(c: Column) -> Column:
    return S.strip_ws(F.coalesce(c, F.lit("")))


def parse_news_feed(feeds: DataFrame, xml_col: str = "xml", limit: int = K.NEWS_CANDIDATES_PER_FEED) -> DataFrame:
    """A3: items of each RSS feed row: trimmed title/link/pubDate/source; blank title or link
    dropped; first occurrence per link; source falls back to the text after the last '-' in the
    title, else 'Unknown'; the first `limit` survivors per feed. A malformed feed yields no items."""
    keys = [c for c in feeds.columns if c != xml_col]
    parsed = feeds.select(*keys, F.from_xml(F.col(xml_col), NEWS_FEED_SCHEMA, {"mode": "PERMISSIVE"}).alias("p"))
    items = parsed.select(*keys, F.posexplode(F.col("p.channel.item")).alias("pos", "it"))
    items = items.select(*keys, F.col("pos").cast("long").alias("pos"), _trim(F.col("it.title")).alias("headline"), _trim(F.col("it.link")).alias("url"),
                         _trim(F.col("it.pubDate")).alias("published_at"), _trim(F.col("it.source._VALUE")).alias("src"))
    items = items.filter((F.col("headline") != "") & (F.col("url") != ""))
    first = Window.partitionBy(*keys, "url").orderBy("pos")
    items = items.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") == 1).drop("_k")
    suffix = F.regexp_extract(F.col("headline"), "-\\s*([^-]+)$", 1)
    fallback = F.when(F.col("headline").rlike("-\\s*([^-]+)$"), _trim(suffix)).otherwise(F.lit("Unknown"))
    items = items.withColumn("source", F.when(F.col("src") != "", F.col("src")).otherwise(fallback)).drop("src")
    w = Window.partitionBy(*keys).orderBy("pos")
    items = items.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
    return items.withColumn("source_weight", S.source_weight(F.col("source")))


def parse_mention_feed(feeds: DataFrame, xml_col: str = "xml", limit: int = K.MENTIONS_PER_FEED) -> DataFrame:
    """A4: the first `limit` items are taken before blank titles/links are dropped; repeats allowed."""
    keys = [c for c in feeds.columns if c != xml_col]
    parsed = feeds.select(*keys, F.from_xml(F.col(xml_col), NEWS_FEED_SCHEMA, {"mode": "PERMISSIVE"}).alias("p"))
    items = parsed.select(*keys, F.posexplode(F.slice(F.coalesce(F.col("p.channel.item"), F.array()), 1, limit)).alias("pos", "it"))
    items = items.select(*keys, F.col("pos").cast("long").alias("pos"), _trim(F.col("it.title")).alias("headline"), _trim(F.col("it.link")).alias("url"),
                         _trim(F.col("it.pubDate")).alias("published_at"))
    return items.filter((F.col("headline") != "") & (F.col("url") != ""))


def shorten_description(text: Column, limit: int = K.VIDEO_DESCRIPTION_MAX) -> Column:
    """A5: trim, newlines -> spaces; over `limit` chars cut at `limit`, drop the last partial word and
    append an ellipsis."""
    t = F.replace(_trim(text), F.lit("\n"), F.lit(" "))
    cut = F.substring(t, 1, limit)
    no_tail = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(t) > limit, F.concat(no_tail, F.lit("…"))).otherwise(t)


def parse_video_feed(feeds: DataFrame, xml_col: str = "xml", limit: int = K.VIDEOS_PER_FEED) -> DataFrame:
    """A5: first `limit` Atom entries, then blank titles dropped; thumbnail and shortened
    description from the media group (namespaces ignored)."""
    keys = [c for c in feeds.columns if c != xml_col]
    parsed = feeds.select(*keys, F.from_xml(F.col(xml_col), ATOM_FEED_SCHEMA,
                                            {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("p"))
    items = parsed.select(*keys, F.posexplode(F.slice(F.coalesce(F.col("p.entry"), F.array()), 1, limit)).alias("pos", "e"))
    out = items.select(
        *keys, F.col("pos").cast("long").alias("pos"), _trim(F.col("e.videoId")).alias("video_id"), _trim(F.col("e.title")).alias("title"),
        F.coalesce(F.col("e.link._href"), F.lit("")).alias("url"), _trim(F.col("e.published")).alias("published_at"),
        F.coalesce(F.col("e.group.thumbnail._url"), F.lit("")).alias("thumbnail_url"),
        F.when(F.coalesce(F.col("e.group.description"), F.lit("")) == "", F.lit("")).otherwise(
            shorten_description(F.col("e.group.description"))).alias("description"))
    return out.filter(F.col("title") != "")


def canonical_id(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Canonical link href -> last path segment; valid only when it starts with 'UC'."""
    href = F.regexp_extract(F.col(html_col), '<link rel="canonical" href="([^"]+)"', 1)
    seg = F.substring_index(href, "/", -1)
    return df.withColumn("channel_id", F.when((href != "") & seg.startswith("UC"), seg)).withColumn(
        "channel_status", F.when(href == "", "no_canonical").when(seg.startswith("UC"), "ok").otherwise("unexpected"))


# --------------------------------------------------------------------------------------------
# A7 / A8
# --------------------------------------------------------------------------------------------

def normalize_reviews(raw: DataFrame, per_app: int = 20, body_max: int = 600, time_col: str = "reviewed_at") -> DataFrame:
    """Newest `per_app` reviews per app; trimmed body, empty dropped, first `body_max` chars;
    rating int(score or 0); date yyyy-MM-dd or ''; a missing id becomes gp_<app>_<n> with n the
    number of reviews kept before it."""
    newest = Window.partitionBy("app_id").orderBy(F.col(time_col).desc_nulls_last(), F.col("review_id").desc_nulls_last(),
                                                  F.col("content").desc_nulls_last())
    top = raw.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= per_app)
    body = S.strip_ws(F.coalesce(F.col("content"), F.lit("")))
    kept = top.withColumn("body", body).filter(F.col("body") != "")
    n = F.row_number().over(Window.partitionBy("app_id").orderBy("_r")) - 1
    return kept.select(
        "entity", "app_id",
        F.coalesce(F.col("review_id"), F.concat(F.lit("gp_"), F.col("app_id"), F.lit("_"), n.cast("string"))).alias("id"),
        F.substring(F.col("body"), 1, body_max).alias("body"),
        F.coalesce(F.col("score"), F.lit(0)).cast("int").alias("rating"),
        F.coalesce(F.date_format(F.col(time_col), "yyyy-MM-dd"), F.lit("")).alias("date"),
        F.col("_r").cast("long").alias("feed_pos"),
    )


FEED_BASE = "https://news.example/rss/search"
QUERY_TEMPLATE = K.NEWS_QUERY_TEMPLATE


def percent_encode(col: Column) -> Column:
    """Python quote(s) with '/' safe: space %20, '/' kept, '~' kept, '*' encoded."""
    e = F.url_encode(col)
    for a, b in [("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")]:
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def feed_query(entities: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per entity the override query, else the template; the encoded feed URL."""
    pre, post = QUERY_TEMPLATE.split("{entity}")
    j = entities.join(overrides, "entity", "left")
    q = F.coalesce(F.col("query"), F.concat(F.lit(pre), F.col("entity"), F.lit(post)))
    return j.select("entity", q.alias("query"), F.concat(F.lit(FEED_BASE + "?q="), percent_encode(q),
                                                        F.lit(K.FEED_URL_SUFFIX)).alias("feed_url"))


# --------------------------------------------------------------------------------------------
# Keyed mutations
# --------------------------------------------------------------------------------------------

def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder (see session.cut_lineage)."""
    return cut_lineage(df)


def assign_ids(new: DataFrame, start: Column | int, order: list[Column]) -> DataFrame:
    """Dense ids start+1, start+2, ... in `order`, without a single-partition window: a distributed
    sort, per-partition counts (one small row per partition) and offsets added per partition."""
    ordered = _cut(new.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mono", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = ordered.join(F.broadcast(offs.select("_pid", "_off", "_first")), "_pid")
    base = start if isinstance(start, Column) else F.lit(start)
    return j.withColumn("id", (base + F.col("_off") + (F.col("_mono") - F.col("_first")) + 1).cast("long")).drop(
        "_pid", "_mono", "_off", "_first")


def append_rows(current: DataFrame, new: DataFrame, defaults: dict, order: list[Column]) -> DataFrame:
    """Fill NULLs of the new rows with the table defaults, give them ids after max(id), append."""
    filled = new
    for c, v in defaults.items():
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    start = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    with_ids = assign_ids(filled.drop("id"), int(start), order)
    return current.unionByName(with_ids.select(*current.columns))


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], newest: str = "updated_at",
           text_col: str = "content_text", hash_col: str = "content_hash", max_chars: int = K.SNAPSHOT_TEXT_MAX) -> DataFrame:
    """A10: replace the whole row per key with the update; the stored text is cut to `max_chars`
    while the hash stays that of the full text (computed upstream)."""
    upd = updates.withColumn(text_col, F.substring(F.col(text_col), 1, max_chars))
    both = current.withColumn("_src", F.lit(0)).unionByName(upd.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_src").desc(), F.col(newest).desc())
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "_src")


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of `new` whose key is not stored; within the batch the first row (in `order`) wins.
    Returns only the rows to insert."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    return first.join(current.select(*keys).distinct(), keys, "left_anti")


def backfill(current: DataFrame, seed: DataFrame, key: str = "entity", only_if_empty: bool = False) -> DataFrame:
    """Seed rows of every key that has no row at all (variant: all seed rows when the table is
    empty, decided by a one-row probe)."""
    if only_if_empty:
        # a left-anti join against a probe of at most one row: all seed rows survive iff it is empty
        probe = current.select(F.lit(1).alias("_p")).limit(1)
        return current.unionByName(seed.join(F.broadcast(probe), how="left_anti", on=F.lit(True)))
    return current.unionByName(seed.join(current.select(key).distinct(), key, "left_anti"))


def bootstrap_scores(events: DataFrame, scores: DataFrame, entities: list[str], weights: DataFrame) -> DataFrame:
    """For listed entities without any score: one score per historical event, every component
    equal to the event impact except the static weight; reason '<date>: <description> (<source>)',
    scanned at '<date>T00:00:00+00:00'."""
    todo = events.filter(F.col("entity").isin(*entities)).join(scores.select("entity").distinct(), "entity", "left_anti")
    imp = F.col("impact_score").cast("double")
    return todo.join(weights, "entity", "left").select(
        "entity", imp.alias("threat_score"), imp.alias("review_component"), imp.alias("news_component"),
        imp.alias("feature_velocity_component"),
        F.coalesce(F.col("static_weight"), F.lit(K.STATIC_DEFAULT)).cast("double").alias("smb_relevance_component"),
        imp.alias("social_component"), imp.alias("offers_component"),
        F.concat(F.col("event_date"), F.lit(": "), F.col("description"), F.lit(" ("), F.col("source"), F.lit(")")).alias("reason"),
        F.concat(F.col("event_date"), F.lit("T00:00:00+00:00")).alias("scanned_at"),
        F.col("id").alias("event_id"))


def bootstrap_entities(events: DataFrame, seed_changes: DataFrame, scores: DataFrame, changes: DataFrame,
                       entities: list[str], weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to insert for listed entities: the events and a score per event of those without any score,
    and the seed changes of those without any change."""
    unscored = events.filter(F.col("entity").isin(*entities)).join(scores.select("entity").distinct(), "entity", "left_anti")
    unchanged = seed_changes.filter(F.col("entity").isin(*entities)).join(changes.select("entity").distinct(), "entity", "left_anti")
    return unscored.select(*events.columns), bootstrap_scores(events, scores, entities, weights), unchanged.select(*seed_changes.columns)


def bulk_load(df: DataFrame, target: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cast every column to its target type; a row whose non-NULL value fails a cast is
    'failed'. Returns (loaded rows, per-status counts with the total)."""
    cast = {c: F.col(c).try_cast(t) for c, t in target.items()}
    failed = F.lit(False)
    for c in target:
        failed = failed | (F.col(c).isNotNull() & cast[c].isNull())
    typed = df.select(*[cast[c].alias(c) for c in target], F.when(failed, "failed").otherwise("ok").alias("status"))
    counts = typed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return typed.filter(F.col("status") == "ok").drop("status"), counts


def load_checked(df: DataFrame, target: dict[str, str], path: str) -> tuple[DataFrame, dict]:
    """Write the rows whose casts succeed, and check the totals: rows are counted by metrics observed in the writing
    pass (no second scan of the source), and the written table must hold exactly those that did not fail."""
    cast = {c: F.col(c).try_cast(t) for c, t in target.items()}
    failed = F.lit(False)
    for c in target:
        failed = failed | (F.col(c).isNotNull() & cast[c].isNull())
    seen = Observation()
    typed = df.select(*[cast[c].alias(c) for c in target], failed.alias("_failed")).observe(
        seen, F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("_failed"), 1)).alias("failed"))
    typed.filter(~F.col("_failed")).drop("_failed").write.parquet(path)
    loaded = df.sparkSession.read.parquet(path)
    counts = {**seen.get, "loaded": loaded.count()}  # from the files' footers
    if counts["loaded"] != counts["total"] - counts["failed"]:
        raise ValueError(f"the load lost or repeated rows: {counts}")
    return loaded, counts


ERRORS_PER_CHUNK = 100
_LEDGER = ["run_id", "kind", "seq", "at", "text"]


def ledger_rows(runs: DataFrame, kind: str, at: str | None = None, seq: str | None = None, text: str | None = None) -> DataFrame:
    """Rows of the append-only run ledger; kind is start, finish or error."""
    none = lambda t: F.lit(None).cast(t)
    return runs.select("run_id", F.lit(kind).alias("kind"), (F.col(seq).cast("long") if seq else none("long")).alias("seq"),
                       (F.col(at) if at else none("string")).alias("at"), (F.col(text) if text else none("string")).alias("text"))


def run_states(ledger: DataFrame) -> DataFrame:
    """The state of every run, by partial aggregates over its rows: 'running' until a finish row comes, then
    'completed' iff there is no error. A stored run is updated by appending a row with its id."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    g = ledger.groupBy("run_id").agg(
        F.min(of("start", "at")).alias("started_at"), F.max(of("finish", "at")).alias("finished_at"),
        F.count(of("error", "kind")).alias("n_errors"))
    status = F.when(F.col("finished_at").isNull(), "running").when(F.col("n_errors") == 0, "completed").otherwise("completed_with_errors")
    return g.select("run_id", "started_at", "finished_at", status.alias("status"), "n_errors")


def run_errors(ledger: DataFrame) -> DataFrame:
    """(run_id, no, error), a run's errors numbered from 1 in order, without collecting a run."""
    rows = numbered(ledger.where("kind = 'error'").select("run_id", "seq", F.col("text").alias("error")),
                    [F.asc_nulls_first("run_id"), F.asc_nulls_first("seq"), F.asc_nulls_first("error")], "_n")
    first = rows.groupBy("run_id").agg(F.min("_n").alias("_first")).select(F.col("run_id").alias("_run"), "_first")
    return rows.join(first, F.col("run_id").eqNullSafe(F.col("_run"))).select(
        "run_id", (F.col("_n") - F.col("_first") + 1).alias("no"), "error")


def error_texts(ledger: DataFrame, per_chunk: int = ERRORS_PER_CHUNK) -> DataFrame:
    """(run_id, chunk, details): the errors joined by '; ', at most `per_chunk` in a row."""
    rows = run_errors(ledger).withColumn("chunk", F.floor((F.col("no") - 1) / per_chunk).cast("long"))
    parts = rows.groupBy("run_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("no", "error"))).alias("e"))
    return parts.select("run_id", "chunk", F.array_join(F.transform("e", lambda x: x["error"]), "; ").alias("details"))
