"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, all native.

1. Documents are aggregated into cells of (source, language, topic) with their tokens.
2. Raking: the cells' weights are scaled to each target marginal in turn, until every marginal is within `TOLERANCE`
   of its target (as a share of all tokens). Targets that no weights of the cells can meet are reported by a warning.
3. A cell's documents are kept with probability min(1, scale * weight / tokens); the scale makes the
   expected tokens equal `fraction` of all (water filling: cells that reach 1 leave their rest to
   the others, until no further cell does). A document's draw is a hash of its doc_id, so every run picks the same documents.

Two stand-ins keep this operator native: a document's tokens are its bytes / 4, rounded up, and its topic is the form
of its text (empty, table, list or prose).

Only the cells are raked; their number is the product of the label sets, not of the documents, and
the raked cells are broadcast only while they are few, else joined by shuffle.

Default targets flatten each marginal: shares proportional to its token share to the power
`TEMPER`. Given targets are {column: {value: share}}; a value without a share gets none.

Defined results: a null label is the value "(none)"; null or empty texts have no tokens and topic
"empty", and follow their cell (probability 0 in a cell without tokens); a null doc_id is drawn by
the text; repeated rows are drawn alike; other columns pass through, a column of a result's name is
replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .tables import untouched

KEYS = ("source", "lang", "topic")
TOLERANCE = 1e-8
ROUNDS = 5  # of raking between two looks at the marginals
TEMPER = 0.5
FRACTION = 0.5
SEED = 17
BROADCAST_CELLS = 50_000


def topic(text: Column) -> Column:
    """The form of a text as its topic label: empty, table (many bars), list (short lines) or prose."""
    t = F.coalesce(text, F.lit(""))
    n, count = F.length(t), lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (F.when(n == 0, "empty").when(20 * count("|") >= n, "table")
            .when(200 * count("\n") >= n, "list").otherwise("prose"))


def tokens(text: Column) -> Column:
    """Token weight of a text: a token for each four bytes begun."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def draw(seed: int) -> Column:
    """A uniform number in [0, 1) for every document, fixed by its doc_id (or its text without one)."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(who, F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _targets(cells: DataFrame, key: str, given: dict | None) -> DataFrame:
    """(key, share): the target marginal over the values that have tokens."""
    sums = cells.groupBy(key).agg(F.sum("tokens").alias("t"))
    if given is None:
        part = F.pow(F.col("t").cast("double"), F.lit(TEMPER))
    else:
        part = F.lit(0.0)
        for value, share in given.items():
            part = F.when(F.col(key) == value, F.lit(float(share))).otherwise(part)
    parts = sums.select(key, part.alias("part"))
    total = parts.agg(F.sum("part").alias("all")).first()[0] or 1.0  # one number
    return parts.select(key, (F.col("part") / F.lit(total)).alias(f"share_{key}"))


def rake(cells: DataFrame, keys=KEYS, targets: dict | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with `weight`: their tokens scaled to every marginal in turn, until all are met."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for key in keys:
        cells = cells.join(_targets(cells, key, (targets or {}).get(key)), key)
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    have = {key: F.sum("weight").over(Window.partitionBy(key)) for key in keys}  # windows over cells, never over documents
    before = float("inf")
    while True:
        for _ in range(ROUNDS):
            for key in keys:
                cells = cells.withColumn("weight", F.when(
                    have[key] > 0, F.col("weight") * F.col(f"share_{key}") * F.lit(total) / have[key]).otherwise(F.lit(0.0)))
        cells = cut_lineage(cells)
        away = cells.select(*[F.abs(have[key] - F.col(f"share_{key}") * F.lit(total)).alias(key) for key in keys])
        off = max((x or 0.0 for x in away.agg(*[F.max(key) for key in keys]).first()), default=0.0)
        if off <= tolerance * total:
            return cells
        if off > 0.99 * before:
            warnings.warn(f"the cells cannot meet the targets: a marginal stays {off / total:.2%} of all tokens away")
            return cells
        before = off


def probabilities(cells: DataFrame, fraction: float) -> DataFrame:
    """Cells with `probability`: the share of their documents to keep."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    cells = cells.withColumn("ratio", ratio)
    budget = fraction * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    scale, before = fraction, None
    while scale != before:  # every step but the last fills a further cell
        full = F.col("ratio") * F.lit(scale) >= 1
        row = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        before, scale = scale, max(scale, (budget - (row["full"] or 0)) / row["open"]) if row["open"] else scale
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)))


def mix(docs: DataFrame, targets: dict | None = None, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """Add topic, n_tokens, probability and sampled to every document."""
    labels = {k: F.coalesce(F.col(k).cast("string"), F.lit("(none)")).alias(f"_{k}") for k in KEYS}
    rows = docs.withColumns({"topic": topic(F.col("text")), "n_tokens": tokens(F.col("text"))})
    cells = cut_lineage(rows.select(*labels.values(), "n_tokens").groupBy(*[f"_{k}" for k in KEYS])
                        .agg(F.sum("n_tokens").alias("tokens")))
    few = cells.count() <= BROADCAST_CELLS
    cells = cells.withColumnsRenamed({f"_{k}": k for k in KEYS})
    cells = probabilities(rake(cells, KEYS, targets), fraction)
    cells = cells.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "probability")
    rows = rows.drop("probability", "sampled").withColumns({f"_{k}": c for k, c in labels.items()})
    out = rows.join(F.broadcast(cells) if few else cells, [f"_{k}" for k in KEYS])
    return (out.withColumn("sampled", draw(seed) < F.col("probability"))
            .select(*[c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "sampled")],
                    "topic", "n_tokens", "probability", "sampled"))


def draw_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents drawn, as they are."""
    made = ("topic", "n_tokens", "probability", "sampled", *(f"_{k}" for k in KEYS))
    return untouched(docs, made, lambda rows: mix(rows, **kw).where("sampled"))
