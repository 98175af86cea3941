"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def words(text):
    return WORD.findall(text or "")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    """Base spans in order: (kind, start, end)."""
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def base_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    repeated = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


def substring_dedup(rows, width=20):
    """(doc_id, n_words, n_removed, kept_sha256) for each (doc_id, text); null ids come last."""
    key = lambda i: (i is None, i or 0)
    first = {}
    lists = [(i, words(t)) for i, t in rows]
    for i, w in lists:
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            first[k] = min(first.get(k, (key(i), s)), (key(i), s))
    out = []
    for i, w in lists:
        gone = {j for s in range(len(w) - width + 1) if first[tuple(w[s:s + width])] < (key(i), s) for j in range(s, s + width)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def repeats(rows, least):
    """{doc_id: set of word positions covered by a repeated run of ``least`` words}."""
    at = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - least + 1):
            at[tuple(w[s:s + least])].append((i, s))
    out = defaultdict(set)
    for places in at.values():
        if len(set(places)) > 1:
            for i, s in places:
                out[i].update(range(s, s + least))
    return dict(out)


def shingles(text, n=4):
    w = [x.translate(ASCII_LOWER) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def jaccard(rows, percent=85):
    """(doc_id, n_shingles, component_id) for each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    comp = components(len(rows), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    out = []
    for (i, _), s, c in zip(rows, sets, comp):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == c and rows[j][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing, as the contract words it. sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def licence_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def licence_places(text, phrases):
    w = licence_words(text)
    found = []
    for phrase, label in phrases.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(found)


def terms(rows, threshold):
    """{doc index: set of (start, end)} of disclosing terms, from distinct (doc_id, text) rows."""
    import math

    word = re.compile(r"[^\W_]+")
    n = len(rows)
    n_term, holders, users = Counter(), defaultdict(set), defaultdict(set)
    for d, (_, t) in enumerate(rows):
        found = {m[0].lower() for m in word.finditer(t or "")}
        n_term.update(found)
        for term in found:
            users[term].add(d)
        for kind, a, b in pii(t):
            v = t[a:b]
            holders[kind, re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower()].add(d)
    out = defaultdict(set)
    for own in holders.values():
        content = math.log2(n / len(own))
        for term in {m[0].lower() for d in own for m in word.finditer(rows[d][1])}:
            both = own & users[term]
            if len({rows[d][1] for d in both}) < 2 or content <= 0:
                continue
            if math.log2(n * len(both) / (n_term[term] * len(own))) >= threshold * content - 1e-12:
                for d in both:
                    t = rows[d][1]
                    out[d] |= {m.span() for m in word.finditer(t) if m[0].lower() == term
                               and all(m.end() <= x or m.start() >= y for _, x, y in pii(t))}
    return {d: s for d, s in out.items() if s}
