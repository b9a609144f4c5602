"""DuckDB SQL for the queries that SQL can express (over the pre-registered tables)."""

from __future__ import annotations

from . import mixing
from .quality import STOP_WORDS, THRESHOLDS

_MEASURES = {
    "n_words": "n_words", "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words",
    "stop_word_ratio": "n_stop / n_words", "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
}


def _verdict() -> str:
    tests = []
    for r in THRESHOLDS:
        value = _MEASURES[r.measure]
        bounds = [f"{value} >= {r.low}"] * (r.low is not None) + [f"{value} <= {r.high}"] * (r.high is not None)
        tests.append(f"(n_words < {r.min_words} OR ({' AND '.join(bounds)}))")
    return " AND ".join(tests)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s
         FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS t(k) GROUP BY r),
m AS (SELECT d.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS n_stop
      FROM d),
c AS (SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM m LEFT JOIN covered USING (r)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {_verdict()} END AS kept
FROM f"""

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_NORM)

OP8 = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_KEY_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, len(p) AS n, array_to_string(p, ' ') AS s
         FROM (SELECT item, w[i:i + 9] AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_KEY_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT r, i, places.n, item FROM places JOIN wins ON wins.n = places.n AND wins.s = array_to_string(w[i:i + places.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


_ROUNDS, _STEPS = 25, 12  # as many as any of the test tables needs


def _mix_sql() -> str:
    keys = mixing.KEYS
    t = "coalesce(text, '')"
    bars, lines = (f"(length({t}) - length(replace({t}, {c}, '')))" for c in ("'|'", "chr(10)"))
    out = [f"""d AS (SELECT doc_id, text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN length({t}) = 0 THEN 'empty' WHEN 20 * {bars} >= length({t}) THEN 'table'
       WHEN 200 * {lines} >= length({t}) THEN 'list' ELSE 'prose' END AS topic,
  ceil(strlen({t}) / 4)::BIGINT AS n_tokens FROM documents)""",
           f"cells AS MATERIALIZED (SELECT {', '.join(keys)}, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
           "total AS (SELECT sum(tokens) AS all_tokens FROM cells)"]
    for k in keys:
        out.append(f"""t_{k} AS (SELECT {k}, part / sum(part) OVER () AS share_{k}
  FROM (SELECT {k}, pow(sum(tokens), {mixing.TEMPER}) AS part FROM cells GROUP BY {k}))""")
    joins = " ".join(f"JOIN t_{k} USING ({k})" for k in keys)
    out.append(f"w0 AS MATERIALIZED (SELECT *, tokens AS weight FROM cells {joins}, total)")
    n = 0
    for _ in range(_ROUNDS):
        for k in keys:
            have = f"sum(weight) OVER (PARTITION BY {k})"
            out.append(f"""w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {have} > 0
  THEN weight * share_{k} * all_tokens / {have} ELSE 0 END AS weight) FROM w{n})""")
            n += 1
    out.append(f"r AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM w{n})")
    out.append(f"s0 AS (SELECT {mixing.FRACTION}::DOUBLE AS scale)")
    for i in range(_STEPS):
        out.append(f"""s{i + 1} AS MATERIALIZED (SELECT coalesce(
  greatest(any_value(scale), ({mixing.FRACTION} * any_value(all_tokens) - coalesce(sum(tokens) FILTER (ratio * scale >= 1), 0))
  / nullif(sum(weight) FILTER (ratio * scale < 1), 0)), any_value(scale)) AS scale FROM r, s{i})""")
    using = " AND ".join(f"d.{k} = r.{k}" for k in keys)
    who = "coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))"
    draw = f"('0x' || substr(md5({who} || ':{mixing.SEED}'), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r}"
    return f"""WITH {", ".join(out)}
SELECT doc_id, d.topic, n_tokens, round(least(1.0, ratio * scale), 6) AS probability,
  {draw} < least(1.0, ratio * scale) AS sampled
FROM d JOIN r ON {using}, s{_STEPS}"""


_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_NORM)

OP12 = rf"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT DISTINCT t FROM q),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) JOIN asked USING (t) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t, docs),
part AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS s
         FROM tf JOIN sizes USING (r) JOIN weights USING (t), whole),
total AS (SELECT item_id, r, sum(s)::BIGINT AS score FROM q JOIN part USING (t) GROUP BY item_id, r HAVING sum(s) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM total JOIN sizes USING (r) QUALIFY rank <= 50"""

ORACLES = {"op4_quality_rules": OP4, "op8_decontamination": OP8, "op10_mix_to_targets": _mix_sql(),
           "op12_shared_search": OP12}
