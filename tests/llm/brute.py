"""Plain, slow versions of the operators that SQL cannot express, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def near_duplicates(rows):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text) rows with distinct ids: every pair is tested."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for e in index[x]:
                shared[e] += 1
        for e, n in shared.items():
            if e < d and 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def remove_repeats(rows, length=400):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] of (doc_id, text) rows: every string is counted."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = defaultdict(int)
    for _, b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] += 1
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def damaged(rows):
    """[(conv_id, turn, role, text)] after the planted faults."""
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        elif case == 2:
            text = re.sub("[.!?]", "", text)
        elif case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) over all rows (initial, must go, truncated), by dynamic programming."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                way = (cost + 5, audit + "I")
                if wanted[state] not in best or way < best[wanted[state]]:
                    best[wanted[state]] = way
        return best

    best = insert({"": (0, "")})
    for role, gone, truncated in rows:
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 2, "D")]
            if not gone:
                ways.append((wanted[state], cost + 1 + 5 * truncated, "R"))
                if (state, role) in step:
                    ways.append((step[state, role], cost + 5 * truncated, "K"))
            for to, c, e in ways:
                if to not in new or (c, audit + e) < new[to]:
                    new[to] = (c, audit + e)
        best = insert(new)
    return min(best[s] for s in ("", "a") if s in best)


def repaired(rows, convs):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} of damaged rows."""
    of = {c: [] for c in convs}
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, found in of.items():
        found.sort()
        turns = [t for given, t, *_ in found if given]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marks, faults = set(), [], Counter()
        for _, _, role, _, text in found:
            ink = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = cheapest(marks)
        lines, state, at = [], "", 0
        for e in audit:
            wanted = "a" if state == "u" else "u"
            if e in "RI":
                state = wanted
                lines.append(("user:" if state == "u" else "assistant:") + (found[at][4] if e == "R" else ""))
            elif e == "K":
                state = found[at][2][:1]
                lines.append(f"{found[at][2]}:{found[at][4]}")
            at += e != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)
    return out


def ranked(docs, items, top=50):
    """[(item_id, rank, doc_id, score)] of (doc_id, text) and (item_id, text) rows."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in wanted if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top])]
    return out


def contaminated(text, items, window=10):
    """Whether a window of an item occurs in a text."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    wanted = defaultdict(set)
    for t in items:
        w = words(t)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            wanted[len(w[i:i + window])].add(tuple(w[i:i + window]))
    mine = words(text)
    return any(tuple(mine[i:i + n]) in found for n, found in wanted.items() for i in range(len(mine) - n + 1))


def drawn(rows, temper=0.5, fraction=0.5, seed=17):
    """Ids of (doc_id, text, source, lang) rows that are drawn: raked cells, water filling, one hash for each id."""
    def topic(t):
        return ("empty" if not t else "table" if 20 * t.count("|") >= len(t) else "list" if 200 * t.count("\n") >= len(t) else "prose")

    cell = {d: (s or "(none)", g or "(none)", topic(t or "")) for d, t, s, g in rows}
    tokens = Counter()
    for d, t, _, _ in rows:
        tokens[cell[d]] += -(-len((t or "").encode()) // 4)
    total, weight = sum(tokens.values()), {c: float(n) for c, n in tokens.items()}
    shares = []
    for k in range(3):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[k]] += n
        parts = {v: n**temper for v, n in sums.items()}
        shares.append({v: p / sum(parts.values()) for v, p in parts.items()})
    for _ in range(60):
        for k in range(3):
            have = Counter()
            for c, w in weight.items():
                have[c[k]] += w
            weight = {c: w * shares[k][c[k]] * total / have[c[k]] if have[c[k]] else 0.0 for c, w in weight.items()}
    ratio = {c: weight[c] / n if n else 0.0 for c, n in tokens.items()}
    scale, before = fraction, None
    while scale != before:
        full = sum(n for c, n in tokens.items() if ratio[c] * scale >= 1)
        rest = sum(weight[c] for c in tokens if ratio[c] * scale < 1)
        before, scale = scale, max(scale, (fraction * total - full) / rest) if rest else scale
    chance = lambda d: int(hashlib.md5(f"{d}:{seed}".encode()).hexdigest()[:13], 16) / 16**13
    return {d for d in cell if chance(d) < min(1.0, ratio[cell[d]] * scale)}
