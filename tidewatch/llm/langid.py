"""Language ID: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

Training: a bounded sample of the labelled documents (at most `TRAIN_DOCS` of each language, those
with the smallest hash of doc_id) is cut into character 4-grams and counted in Spark; the counts of
the sample come to the driver, which derives the lower orders' continuation counts, discounts and
back-off weights. The models of all languages share one sorted array of 64-bit n-gram hashes per
order, with a row of log probabilities (one per language) next to every hash.

Scoring: texts are lower-cased, every run of non-letters becomes one blank, and each character is
looked up at the highest order that any language has seen, backing off for the others. The language
of the lowest cross-entropy per character wins. A fifth of the sample stays out of the counts and
calibrates the rejection by an order statistic (split conformal): at most `SHARE` of a language's own further
documents are rejected, whatever their distribution. Fewer than 1 / SHARE held-back documents support a share of
1 / (n + 1) only; there the limit is drawn out by Student's t.
Cross-entropies are compared with the middle and spread of their length class (powers of 4 letters; a class
of under `CLASS_DOCS` held-back documents is pooled with its nearest ones); a language of under three
such documents rejects nothing.

No shuffle of documents: scoring is one Arrow function over whole texts.

Defined results: null texts and texts without a letter are `und`, score 0, rejected; without any
labelled document every prediction is `und` and nothing is rejected; equal cross-entropies go to
the first language in order; rows with a null language or doc_id are not learned from; repeated
rows are scored alike; other columns pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import untouched
from .worker import held

ORDER = 4
TRAIN_DOCS = 1500  # of each language
SHARE = 0.005  # of a language's own documents that may be rejected
N_CLASSES = 16
CLASS_DOCS = 10  # held-back documents that a length class is calibrated from, at least
CHUNK_CHARS = 1 << 17

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RESULT = "lang_pred string, score double, xent double, n_letters long, rejected boolean"
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("xent", pa.float64()),
                    ("n_letters", pa.int64()), ("rejected", pa.bool_())])
_LETTERS: list[np.ndarray] = []  # per code point: is it a letter; its mixed value


def _letters() -> np.ndarray:
    """Which code points are letters (built once in a process)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _mixed(points: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits, so that sums of their multiples tell n-grams apart."""
    x = points.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _mixed_table() -> np.ndarray:
    """`_mixed` of every code point."""
    if len(_LETTERS) < 2:
        _letters()
        _LETTERS.append(_mixed(np.arange(0x110000, dtype=np.uint32)))
    return _LETTERS[1]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (each: ORDER-1 zeros, a blank, then words parted by one blank), the
    text of every code point, and the number of letters of every text."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    doc = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    is_letter = _letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (doc[1:] == doc[:-1])  # the first other character after a letter
    points[~is_letter] = 32
    n_letters = np.bincount(doc[is_letter], minlength=len(low))
    points, doc = points[keep], doc[keep]
    out = np.zeros(len(points) + ORDER * len(low), np.uint32)
    at = np.arange(len(points)) + ORDER * (doc + 1)
    out[at] = points
    owner = np.repeat(np.arange(len(low)), np.bincount(doc, minlength=len(low)) + ORDER)
    starts = np.searchsorted(owner, np.arange(len(low)))
    out[starts + ORDER - 1] = 32
    return out, owner, n_letters


def gram_hash(gram: str) -> int:
    """The hash of one n-gram; equals what `_hash_at` gives at its last character."""
    mixed = _mixed(np.array([ord(c) for c in reversed(gram)], np.uint32)).tolist()
    return sum(c * scale for c, scale in zip(mixed, _SCALES)) & 0xFFFFFFFFFFFFFFFF


_SCALES = [1]
for _ in range(ORDER - 1):
    _SCALES.append(_SCALES[-1] * int(_PRIME) & 0xFFFFFFFFFFFFFFFF)


def _hash_at(mixed: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at the positions `at`."""
    h = mixed[at]
    for k in range(1, n):
        h += mixed[at - k] * np.uint64(_SCALES[k])
    return h


class Table:
    """Sorted hashes with a row of values each; the top bits of a hash say where its run begins."""

    def __init__(self, keys: list[str], rows):
        h = np.array([gram_hash(k) for k in keys], np.uint64)
        order = np.argsort(h)
        self.keys, self.rows = h[order], np.asarray(rows, np.float32)[order]
        bits = max(1, int(8 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        runs = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = (np.cumsum(runs) - runs).astype(np.int32)
        self.longest = int(runs.max())

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it is there."""
        last = len(self.keys) - 1
        at = np.minimum(np.take(self.start, wanted >> self.shift), last)
        found = np.take(self.keys, at) == wanted
        rest = np.flatnonzero(~found)
        for step in range(1, self.longest):
            if not len(rest):
                break
            probe = np.minimum(at[rest] + step, last)
            hit = self.keys[probe] == wanted[rest]
            at[rest[hit]], found[rest[hit]] = probe[hit], True
            rest = rest[~hit]
        return at, found


@dataclass
class Model:
    langs: list[str]
    grams: list[Table]  # per order: log probabilities of the n-grams
    backoff: list[Table]  # per order: log weights of the contexts
    floor: np.ndarray  # log probability of a character that no language has seen
    limit: np.ndarray  # per language and length class: the highest cross-entropy that is not rejected

    def _log(self, mixed: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Rows of log probabilities of the characters at positions `at`, from order n downwards."""
        if n == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.langs)))
        table = self.grams[n - 1]
        where, found = table.find(_hash_at(mixed, at, n))
        out = np.take(table.rows, where, axis=0)
        rest = np.flatnonzero(~found)
        if len(rest):
            low = self._log(mixed, at[rest], n - 1).astype(np.float32, copy=True)
            if n > 1:
                table = self.backoff[n - 1]
                where, found = table.find(_hash_at(mixed, at[rest] - 1, n - 1))
                low[found] += table.rows[where[found]]
            out[rest] = low
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of every text under every language, and the texts' letters."""
        points, owner, n_letters = normalised(texts)
        at = np.flatnonzero(points)
        logs, owner = self._log(_mixed_table()[points], at, ORDER), owner[at]
        starts = np.searchsorted(owner, np.arange(len(texts)))  # every text has its leading blank
        sums = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        return -sums / np.diff(np.append(starts, len(at)))[:, None], n_letters

    def judge(self, texts: list[str]) -> list[dict]:
        """Prediction, confidence and rejection of every text."""
        x, n_letters = self.entropies(texts)
        best = x.argmin(1)
        least = x[np.arange(len(x)), best]
        score = 1 / np.exp(-(x - least[:, None]) * np.minimum(n_letters, 200)[:, None]).sum(1)
        limit = self.limit[best, length_class(n_letters)]
        return [
            {"lang_pred": self.langs[b], "score": s, "xent": e, "n_letters": n, "rejected": bool(r)} if n else
            {"lang_pred": "und", "score": 0.0, "xent": None, "n_letters": 0, "rejected": True}
            for b, s, e, n, r in zip(best.tolist(), score.tolist(), least.tolist(), n_letters.tolist(), least > limit)]


def _estimate(counts: dict[str, dict[str, int]]) -> Model:
    """Interpolated Kneser-Ney models from the languages' ORDER-gram counts."""
    langs = sorted(counts)
    chars = {c for grams in counts.values() for g in grams for c in g}
    uniform = 1.0 / (len(chars) + 1)
    levels = {}  # language -> per order: counts (raw at the top, continuations below)
    for lang in langs:
        tables = [dict(counts[lang])]
        for _ in range(ORDER - 1):
            tables.append(dict(Counter(g[1:] for g in tables[-1])))
        levels[lang] = tables[::-1]
    below: dict[str, dict[str, float]] = {lang: {} for lang in langs}
    grams, backoff = [], []
    for n in range(1, ORDER + 1):
        share, weight = {}, {}
        for lang in langs:
            table = levels[lang][n - 1]
            once, twice = (sum(1 for v in table.values() if v == k) for k in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total, kinds = defaultdict(int), defaultdict(int)
            for g, v in table.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            weight[lang] = {c: discount * kinds[c] / total[c] for c in total}
            share[lang] = {g: (v - discount) / total[g[:-1]] for g, v in table.items()}
        union = sorted({g for lang in langs for g in share[lang]})
        probs = {lang: {g: share[lang].get(g, 0.0) + weight[lang].get(g[:-1], 1.0)
                        * (below[lang][g[1:]] if n > 1 else uniform) for g in union} for lang in langs}
        below = probs
        grams.append(Table(union, np.log([[probs[lang][g] for lang in langs] for g in union])))
        contexts = sorted({c for lang in langs for c in weight[lang]})
        backoff.append(Table(contexts, np.log([[weight[lang].get(c, 1.0) for lang in langs] for c in contexts])))
        if n == 1:
            floor = np.log(np.array([weight[lang].get("", 1.0) * uniform for lang in langs]))
    return Model(langs, grams, backoff, floor.astype(np.float32), np.full((len(langs), N_CLASSES), np.inf))


def length_class(n_letters) -> np.ndarray:
    """0 for 1-3 letters, 1 for 4-15, and so on."""
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(np.int64) // 2, N_CLASSES - 1)


def limits(xent, n_letters) -> np.ndarray:
    """The calibrated limit of every length class, from a language's held-back documents.

    Cross-entropies are set in relation to the middle and the spread of their length class (with the nearest
    classes, if it has few documents), and the limit is an order statistic of all of the language's: the
    ceil((n + 1) * (1 - SHARE))-th smallest, so that a further document of the language exceeds it with a probability of
    SHARE at most, whatever the distribution. From fewer than 1 / SHARE documents the largest is taken, which supports
    a share of 1 / (n + 1).
    """
    x, of = np.asarray(xent, float), length_class(np.asarray(n_letters, float))
    out = np.full(N_CLASSES, np.inf)
    if len(x) < 3:
        return out
    def scale(k: int, x: np.ndarray, of: np.ndarray) -> tuple[float, float]:
        away = np.abs(of - k)
        near = x[away <= np.sort(away)[min(CLASS_DOCS, len(x)) - 1]]
        return float(np.median(near)), max(float(near.std(ddof=1)) if len(near) > 1 else 0.0, 1e-3)

    apart = []
    for i in range(len(x)):  # a document is no part of what it is measured by, as a further one would not be
        middle, spread = scale(of[i], np.delete(x, i), np.delete(of, i))
        apart.append((x[i] - middle) / spread)
    rank = int(np.ceil((len(x) + 1) * (1 - SHARE)))
    limit = np.sort(apart)[min(len(x), rank) - 1]
    for k in range(N_CLASSES):
        middle, spread = scale(k, x, of)
        out[k] = middle + max(limit, _tail(k, x, of) if rank > len(x) else 0.0, 0.0) * spread
    return out


def _tail(k: int, x: np.ndarray, of: np.ndarray) -> float:
    """Where too few documents were held back for the share, none of which may exceed it: Student's t of a further
    document of the class, in spreads from its middle."""
    away = np.abs(of - k)
    near = x[away <= np.sort(away)[min(CLASS_DOCS, len(x)) - 1]]
    free, spread = len(near) - 1, max(float(near.std(ddof=1)), 1e-3)
    z = NormalDist().inv_cdf(1 - SHARE / 5)
    t = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free**2)
    return (float(near.mean()) - float(np.median(near))) / spread + t * np.sqrt(1 + 1 / len(near))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > CHUNK_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def sample(labelled: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """(text, lang, part) of at most `per_lang` documents of each language; part 0 calibrates."""
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("bucket", F.shiftright("h", 52))
    # counts of 4096 hash ranges tell where a language's sample ends, so only rows up to there are ranked
    ahead = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    last = (hashed.groupBy("lang", "bucket").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(ahead, F.lit(0)))
            .where(F.col("ahead") < per_lang).groupBy("lang").agg(F.max("bucket").alias("last")))  # a row per learned language
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = (hashed.join(F.broadcast(last), "lang").where("bucket <= last")
              .withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= per_lang)
              .select("doc_id", "lang", F.pmod(F.col("rank"), F.lit(5)).alias("part")).dropDuplicates(["doc_id", "lang"]))
    # picked has at most per_lang rows for each learned language: broadcast, so no text is shuffled
    return known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])


def train(labelled: DataFrame, per_lang: int = TRAIN_DOCS) -> Model | None:
    """Models of every language of the labelled documents, with calibrated rejection."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language models", dict)
        for batch in batches:
            found: dict = defaultdict(Counter)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points, _, n_letters = normalised([text])
                if n_letters[0]:
                    s = "".join(map(chr, points))
                    found[lang].update(map("".join, zip(*(s[k:] for k in range(ORDER)))))
            rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])

    picked = sample(labelled, per_lang)
    grams = (picked.where("part > 0").select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict())  # bounded by the sample
    counts: dict = defaultdict(dict)
    for lang, g, n in zip(grams["lang"], grams["gram"], grams["n"]):
        counts[lang][g] = n
    if not counts:
        return None
    model = _estimate(counts)
    seen = (picked.where("part = 0").select("lang", classifier(model)(F.col("text")).alias("r"))
            .where("lang = r.lang_pred").select("lang", "r.xent", "r.n_letters").toArrow().to_pydict())
    by_lang = defaultdict(list)
    for lang, x, n in zip(seen["lang"], seen["xent"], seen["n_letters"]):
        by_lang[lang].append((x, n))
    model.limit = np.array([limits(*(zip(*by_lang[lang]) if by_lang[lang] else ((), ()))) for lang in model.langs])
    return model


def classifier(model: Model):
    """The scoring function of a model as a column function of a text."""
    from pyspark.sql import SparkSession

    model_b = SparkSession.active().sparkContext.broadcast(model)  # bounded by the training sample

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model_b.value
        held("language models", dict)  # lets go what another operator kept
        for texts in batches:
            yield pa.array([r for group in _chunks([t or "" for t in texts.to_pylist()]) for r in m.judge(group)], _ARROW)

    return F.arrow_udf(judge, _RESULT).asNondeterministic()  # a filter on the result must not run it twice


def held_out() -> Column:
    """The fold that is never learned from: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame | None = None, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """Add `held_out` and `language` (lang_pred, score, xent, n_letters, rejected) to every document.

    `labelled` (default: the documents themselves, without the held-out fold) is learned from.
    """
    labelled = docs.where(~held_out()) if labelled is None else labelled
    model = train(labelled, per_lang)
    df = docs.withColumn("held_out", held_out())
    if model is None:
        return df.withColumn("language", F.struct(
            F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("xent"),
            F.lit(0).cast("long").alias("n_letters"), F.lit(False).alias("rejected")))
    return df.withColumn("language", classifier(model)(F.col("text")))


def known(docs: DataFrame, **kw) -> DataFrame:
    """The documents whose language is known to the models, as they are."""
    return untouched(docs, ("held_out", "language"), lambda rows: identify(rows, **kw).where("NOT language.rejected"))
