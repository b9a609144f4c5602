"""H1-H2: maintenance rewrites, expressed as pure old-table -> new-table functions.

No table format with in-place updates is installed, so a rewrite returns the new DataFrame; the
caller persists it by writing a fresh versioned directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S


def rewrite_reasons(scores: DataFrame, special_entity: str, special_text: str, generic_text: str) -> DataFrame:
    """H1: reasons containing the unavailable marker get an entity-specific text for one entity and a
    generic text for the rest; other rows are unchanged."""
    hit = F.col("reason").contains(K.UNAVAILABLE_MARKER)
    new = (F.when(hit & (F.col("entity") == special_entity), F.lit(special_text))
           .when(hit, F.lit(generic_text)).otherwise(F.col("reason")))
    return scores.withColumn("reason", new)


def delete_before(scores: DataFrame, cutoff: str = K.SCORE_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """H2: drop rows whose stored scanned_at text sorts before the cutoff (text comparison, as
    stored). Returns (kept rows, one-row counts of kept and deleted rows from a single pass)."""
    old = S.iso_seconds(F.col("scanned_at")) < F.lit(cutoff)
    kept = scores.filter(~old)
    counts = scores.agg(F.count(F.when(~old, 1)).alias("n_kept"), F.count(F.when(old, 1)).alias("n_deleted"))
    return kept, counts
