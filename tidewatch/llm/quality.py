"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

Words are runs of anything but ASCII white space; lengths count code points. All measures of a row
are computed inside its own row (arrays), so the operator never shuffles and a hot source or a
group of copies costs no more than other rows.

Defined results: a null or empty text has no words and fails `n_words`; a text of one word or line
has ratio 0 for repeats; ties and repeated rows are judged alike; extra columns pass through
unless their name is one of the measures, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
NON_WS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four corpus languages (fixed values).
STOP_WORDS = (
    "the of and to a in is that it for on was with as be this by are at from "
    "der die und den von zu das mit sich des auf für im ist nicht dem ein eine als "
    "de la le et les en un du une que est pour dans qui au sur par pas avec "
    "el y los se del las por con una no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """One line of the threshold table: `low <= measure <= high`, for texts of `min_words` or more."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# Ratios are per word or per line; bounds are inclusive.
THRESHOLDS = (
    Rule("length", "n_words", 10, 1_000_000),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.03, None, min_words=60),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
)


def _covered(windows: Column, repeated: Column) -> Column:
    """Words inside windows that occur at least twice; `repeated` are their sorted start positions."""
    spans = F.transform(repeated, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(repeated, k + 1) - p, F.lit(5))))
    return F.aggregate(spans, F.lit(0), lambda a, x: a + x)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures to every row: counts (long) and ratios (double)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WS), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NON_WS))
    df = docs.withColumns({"_words": words, "_lines": lines})
    w = F.col("_words")
    df = df.withColumn("_win", F.when(F.size(w) >= 6, F.transform(
        F.sequence(F.lit(0), F.size(w) - 5),
        lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)))))
    # only a text with a repeated window pays for the sort
    win = F.col("_win")
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))
    s = F.col("_sorted")
    df = df.withColumn("_starts", F.when(s.isNotNull(), F.sort_array(F.transform(
        F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False))
                 | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))),
        lambda x: x["i"]))))
    n_words, n_lines = F.size(w).cast("long"), F.size("_lines").cast("long")
    chars = F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long")
    df = df.withColumns({
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_starts").isNull(), F.lit(0))
        .otherwise(_covered(win, F.col("_starts"))).cast("long"),
        "_n_lines": n_lines,
        "_n_stop": F.size(F.filter(w, lambda x: F.translate(x, UPPER, LOWER).isin(STOP_WORDS))),
    })
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(F.lit(0.0))
    df = df.withColumns({
        "mean_word_chars": per_word(F.col("word_chars")),
        "symbol_ratio": per_word(F.col("n_symbols")),
        "stop_word_ratio": per_word(F.col("_n_stop")),
        "dup_line_ratio": F.when(F.col("_n_lines") > 0, F.col("n_dup_lines") / F.col("_n_lines")).otherwise(F.lit(0.0)),
    })
    return df.drop("_words", "_lines", "_win", "_sorted", "_starts", "_n_lines", "_n_stop")


def passes(rule: Rule) -> Column:
    """The rule as one boolean column."""
    c, ok = F.col(rule.measure), F.lit(True)
    if rule.low is not None:
        ok = ok & (c >= rule.low)
    if rule.high is not None:
        ok = ok & (c <= rule.high)
    return (F.col("n_words") < rule.min_words) | ok if rule.min_words else ok


def apply_rules(docs: DataFrame, rules=THRESHOLDS, text: str = "text") -> DataFrame:
    """Measures, the fixed base test, the table's verdict and the names of the failed rules.

    `base_failed`: fewer than 10 words, or over a fifth of the words lie in repeated windows.
    `kept`: not base_failed, and every rule of the table holds.
    """
    df = measure(docs, text)
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
