"""Column functions.

Every function maps Columns to a Column built only from Catalyst expressions, so it stays inside
whole-stage code generation and is evaluated where the data lives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# Python's str.isspace() set. Java's \s misses most of it (NBSP, U+1680, U+2000..U+200A, the
# information separators 0x1C-0x1F ...), so the class is spelled out.
WHITESPACE_CLASS = (
    "[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------------------------
# K1 / D3: rounding and clamping
# --------------------------------------------------------------------------------------------

def round1(col) -> Column:
    """Round a non-negative double to one decimal exactly as Python's round(x, 1) does.

    Python rounds the exact binary value half-to-even. 10*x can land on .5 while x was a hair
    above or below the tie; 2x - ((8x + 2x) - 8x) recovers the error of that product.
    """
    x = _c(col).cast("double")
    t = x * F.lit(10.0)
    lo = F.floor(t)
    err = x * F.lit(2.0) - ((x * F.lit(8.0) + x * F.lit(2.0)) - x * F.lit(8.0))
    tie = F.when(err > 0, F.ceil(t)).when(err < 0, lo).otherwise(
        F.when(lo % 2 == 0, lo).otherwise(lo + F.lit(1)))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(
        t - lo != F.lit(0.5), F.floor(t + F.lit(0.5)) / F.lit(10.0)
    ).otherwise(tie / F.lit(10.0))


def clamp(col, lo, hi) -> Column:
    """max(lo, min(hi, x)); NULL stays NULL (Spark's greatest/least would skip it)."""
    x = _c(col)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def clamp_int(col, lo: int = 1, hi: int = 10) -> Column:
    """int(clamp(x)) - truncation toward zero, as Python's int() does."""
    return clamp(_c(col).cast("double"), float(lo), float(hi)).cast("int")


# --------------------------------------------------------------------------------------------
# Text normalisation
# --------------------------------------------------------------------------------------------

def strip_ws(col) -> Column:
    return F.regexp_replace(_c(col), f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


def clean_text(col) -> Column:
    """B2: whitespace runs -> one space, stripped; NULL -> ''."""
    return strip_ws(F.regexp_replace(F.coalesce(_c(col), F.lit("")), f"{WHITESPACE_CLASS}+", " "))


def normalize_headline(col) -> Column:
    """Drop the trailing ' - Source' part, strip, lower-case, collapse whitespace."""
    ws = WHITESPACE_CLASS
    cut = F.regexp_replace(F.coalesce(_c(col), F.lit("")), f"{ws}*-{ws}*[^-]+$", "")
    return F.regexp_replace(F.lower(strip_ws(cut)), f"{ws}+", " ")


def tokens(col) -> Column:
    """[a-z0-9]+ words of the lower-cased text, longer than 2, minus stop words (with repeats)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    stop = F.array(*[F.lit(w) for w in K.STOPWORDS])
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def content_hash(col) -> Column:
    """SHA-256 hex of the UTF-8 text."""
    return F.sha2(_c(col), 256)


# --------------------------------------------------------------------------------------------
# News source weight and credibility rank
# --------------------------------------------------------------------------------------------

def source_weight(col) -> Column:
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    hit = F.lit(False)
    for name in K.HIGH_VALUE_SOURCES:
        hit = hit | low.contains(name)
    return F.when(hit, F.lit("high")).otherwise(F.lit("low"))


def source_rank(col) -> Column:
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    expr = None
    for i, name in enumerate(K.SOURCE_CREDIBILITY_ORDER):
        expr = F.when(low.contains(name), F.lit(i)) if expr is None else expr.when(low.contains(name), F.lit(i))
    return expr.otherwise(F.lit(len(K.SOURCE_CREDIBILITY_ORDER)))


# --------------------------------------------------------------------------------------------
# bands
# --------------------------------------------------------------------------------------------

def _num(col) -> Column:
    return _c(col).cast("string").try_cast("double")


def score_band(col) -> Column:
    """>= 7 high, >= 4 mid, else low; non-numeric -> grey."""
    s = _num(col)
    return F.when(s.isNull(), "grey").when(s >= K.BAND_HIGH, "high").when(s >= K.BAND_MID, "mid").otherwise("low")


def severity_band(col) -> Column:
    """Inverse colouring of review severity: high severity is good news for the home side."""
    s = _num(col)
    return F.when(s.isNull(), "grey").when(s >= K.BAND_HIGH, "good").when(s >= K.BAND_MID, "mid").otherwise("bad")


def impact_band(col) -> Column:
    s = _num(col)
    return F.when(s.isNull(), "mid").when(s >= K.BAND_HIGH, "high").when(s >= K.BAND_MID, "mid").otherwise("low")


def relevance_level(col) -> Column:
    s = _num(col)
    return F.when(s.isNull(), "Low").when(s >= K.BAND_HIGH, "High").when(s >= K.BAND_MID, "Medium").otherwise("Low")


# --------------------------------------------------------------------------------------------
# K2 / K3 / K4: dates
# --------------------------------------------------------------------------------------------

def _ts(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt))


def lenient_timestamp(col) -> Column:
    """K2: RFC-2822 as mail headers write it (weekday optional, years of two digits, numeric or named zones; a zone that
    is missing or unknown is UTC), ISO-8601 (offsets with or without a colon, none = UTC), 'yyyy-MM-dd HH:mm:ss', date only;
    anything else NULL."""
    raw = F.trim(_c(col))
    rfc = F.regexp_replace(F.regexp_replace(raw, "^[A-Za-z]{3},\\s*", ""), "\\s+", " ")
    short = F.regexp_extract(rfc, "^\\d{1,2} [A-Za-z]{3} (\\d{2}) ", 1)
    century = F.when(short.try_cast("int") > 68, "19").otherwise("20")
    rfc = F.when(short != "", F.concat(F.regexp_extract(rfc, "^(\\d{1,2} [A-Za-z]{3} )", 1), century, F.regexp_extract(
        rfc, "^\\d{1,2} [A-Za-z]{3} (.*)$", 1))).otherwise(rfc)
    offset = F.lit("+0000")
    for zone, value in K.MAIL_ZONES.items():
        offset = F.when(F.upper(F.regexp_extract(rfc, " ([A-Za-z]+)$", 1)) == zone, value).otherwise(offset)
    rfc = F.when(rfc.rlike("[+-]\\d{4}$"), rfc).otherwise(F.concat(F.regexp_replace(rfc, " [A-Za-z]+$", ""), F.lit(" "), offset))
    iso = F.regexp_replace(raw, "([+-]\\d{2})(\\d{2})$", "$1:$2")
    parsed = F.coalesce(
        _ts(rfc, "d MMM yyyy HH:mm:ss Z"),
        _ts(rfc, "d MMM yyyy HH:mm Z"),
        F.when(raw.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?(Z|[+-]\\d{2}:?\\d{2})?)?$"),
               F.when(raw.rlike("T.*[+-]\\d{4}$| .*[+-]\\d{4}$"), iso).otherwise(raw).try_cast("timestamp")),
    )
    return F.when((raw.isNull()) | (raw == ""), F.lit(None).cast("timestamp")).otherwise(parsed)


MIN_TIMESTAMP = "0001-01-01 00:00:00"


def iso_or_min(col) -> Column:
    """K3: ISO-8601 parse; unparseable -> 0001-01-01 so it fails every recency filter."""
    raw = _c(col).cast("string")
    ok = raw.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?)?(Z|[+-]\\d{2}:\\d{2})?$")
    return F.coalesce(F.when(ok, raw.try_cast("timestamp")), F.lit(MIN_TIMESTAMP).cast("timestamp"))


def date_prefix(col) -> Column:
    """K4: text before 'T', at most 10 characters."""
    return F.substring(F.substring_index(F.coalesce(_c(col).cast("string"), F.lit("")), "T", 1), 1, 10)


def iso_seconds(col) -> Column:
    """Timestamp -> stored text form 'yyyy-MM-ddTHH:mm:ss+00:00' (UTC, seconds)."""
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def display_date(col) -> Column:
    """G15: 'Mon dd, yyyy' from the lenient parse, else the first 10 characters of the raw text."""
    parsed = lenient_timestamp(col)
    return F.when(parsed.isNotNull(), F.date_format(parsed, "MMM dd, yyyy")).otherwise(
        F.substring(F.coalesce(_c(col), F.lit("")), 1, 10))


# --------------------------------------------------------------------------------------------
# String helpers
# --------------------------------------------------------------------------------------------

def fmt1(col) -> Column:
    """'%.1f' of a double."""
    return F.format_string("%.1f", _c(col).cast("double"))


def html_escape(col) -> Column:
    out = F.coalesce(_c(col).cast("string"), F.lit(""))
    for ch, rep in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return out


def fold_ascii(col) -> Column:
    """The fixed replacements, then every character outside Latin-1 becomes '?'."""
    out = F.coalesce(_c(col).cast("string"), F.lit(""))
    for ch, rep in K.ASCII_FOLD:
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return F.regexp_replace(out, "[^\\x00-\\xff]", "?")


def is_blank(col) -> Column:
    """No ASCII letter or digit at all."""
    return ~F.coalesce(_c(col), F.lit("")).rlike("[A-Za-z0-9]")
