"""URL filter: rules first, then gradient-boosted trees on lexical features of the url.

Rules (action, host, path) fit their host and its subdomains where the url's path starts with the
rule's; the longest wins. Urls that a rule judges are the labelled urls: a bounded sample of them
(the `TRAIN_URLS` with the smallest hashes) trains the trees, which judge every other url. Features
are plain columns: lengths, depth, digit ratio, character entropy, parameter and mark counts, and
statistics of the host's last label and last two labels over all pages: how many hosts have it, and what share of
its labelled hosts' urls are blocked, every host counting once. The sample bounds the fit alone. A
training url sees the shares of the other folds' hosts only (a host lies in one of FOLDS folds), so the feature is never
the label itself.

Counts are partial aggregates by host, then by suffix; no html moves. The suffix table is broadcast while
it has at most BROADCAST_SUFFIXES rows, else joined by shuffle.

Defined results: a null url, or one without "://", has an empty host and path and no rule; without
labelled urls of both kinds the trees give way to the one kind there is (none: allow); repeated
urls are judged alike; other columns pass through, a column of a result's name is replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

TRAIN_URLS = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "entropy", "n_params",
            "n_hyphens", "n_marks", "has_fragment", "secure", "seen_1", "blocked_1", "seen_2", "blocked_2")
FOLDS = 5
BROADCAST_SUFFIXES = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule string, its action) of the longest rule that fits, null without one."""
    name = action = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer rules wrap shorter ones
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def _features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return {
        "url_chars": F.length(u).cast("double"), "host_chars": F.length(host).cast("double"),
        "path_chars": F.length(path).cast("double"), "depth": count(path, "/[^/]"), "labels": count(host, r"[^.]+"),
        "digit_ratio": count(u, "[0-9]") / n, "entropy": entropy, "n_params": count(u, "[?&][^=&#]+="),
        "n_hyphens": count(u, "-"), "n_marks": count(u, "[^0-9A-Za-z/:.]"),
        "has_fragment": F.contains(u, F.lit("#")).cast("double"), "secure": u.startswith("https:").cast("double"),
        "suffix_1": F.substring_index(host, ".", -1), "suffix_2": F.substring_index(host, ".", -2),
    }


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


def suffix_counts(df: DataFrame, size: int) -> DataFrame:
    """(suffix, by_fold): per fold the hosts of a suffix, its labelled hosts and the sum of their blocked shares."""
    hosts = df.groupBy("host").agg(F.count("_action").alias("n"), F.sum((F.col("_action") == "block").cast("double")).alias("b"))
    rows = hosts.groupBy(F.substring_index("host", ".", -size).alias("suffix"), fold(F.col("host")).alias("fold")).agg(
        F.count("*").alias("hosts"), F.sum((F.col("n") > 0).cast("double")).alias("labelled"),
        F.sum(F.when(F.col("n") > 0, F.col("b") / F.col("n")).otherwise(0.0)).alias("blocked"))
    return rows.groupBy("suffix").agg(F.collect_list(F.struct("fold", "hosts", "labelled", "blocked")).alias("by_fold"))  # FOLDS at most


def _with_suffixes(rows: DataFrame, tables: dict[int, DataFrame], but_fold: Column | None) -> DataFrame:
    """Add seen_k and blocked_k, from the other folds only where `but_fold` is given."""
    for size, table in tables.items():
        rows = rows.join(table.withColumnsRenamed({"suffix": f"suffix_{size}", "by_fold": "_by"}), f"suffix_{size}", "left")
        used = F.coalesce(F.col("_by"), F.array().cast(table.schema["by_fold"].dataType))
        if but_fold is not None:
            used = F.filter(used, lambda f: f["fold"] != but_fold)
        add = lambda name: F.aggregate(used, F.lit(0.0), lambda a, f: a + f[name])
        rows = rows.withColumns({f"seen_{size}": F.log1p(add("hosts")), f"blocked_{size}": (add("blocked") + 1) / (add("labelled") + 2)}).drop("_by")
    return rows


def judge(pages: DataFrame, rules=RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """Add host, path, rule, verdict and block_score (the trees' probability; null where a rule judged)."""
    made = ("host", "path", "rule", "verdict", "block_score", "_action", "suffix_1", "suffix_2", "_by", *FEATURES)
    own = [c for c in pages.columns if c not in made]
    host, path = parts(F.col("url"))
    df = pages.select(*own, host.alias("host"), path.alias("path"))
    rule, action = matched(rules, F.col("host"), F.col("path"))
    df = df.withColumns({"rule": rule, "_action": action})
    lexical = _features(F.col("url"), F.col("host"), F.col("path"))

    sample = (df.where(F.col("_action").isNotNull()).select("url", "host", "path", "_action").distinct()
              .orderBy(F.xxhash64("url"), "url").limit(train_urls))
    sample = cut_lineage(sample.withColumns(lexical).withColumns({
        "label": (F.col("_action") == "block").cast("double"), "_fold": fold(F.col("host"))}).drop("url", "host", "path", "_action").coalesce(2))
    kinds = [r["label"] for r in sample.select("label").distinct().collect()]  # two at most
    out = ["host", "path", "rule"]
    if len(kinds) < 2:
        other = F.lit("block" if kinds == [1.0] else "allow")
        return df.select(*own, *out, F.coalesce("_action", other).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    tables = {}
    for size in (1, 2):
        tables[size] = cut_lineage(suffix_counts(df.select("host", "_action"), size))
        if tables[size].count() <= BROADCAST_SUFFIXES:
            tables[size] = F.broadcast(tables[size])

    def vectors(rows: DataFrame, but_fold: Column | None = None) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_suffixes(rows, tables, but_fold))

    trees = GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, seed=7).fit(
        vectors(sample, F.col("_fold")).select("features", "label"))
    from pyspark.ml.functions import vector_to_array

    scored = trees.transform(vectors(df.withColumns(lexical)))
    score = F.when(F.col("_action").isNull(), F.get(vector_to_array("probability"), F.lit(1)))
    verdict = F.coalesce("_action", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return scored.select(*own, *out, verdict.alias("verdict"), score.alias("block_score"))
