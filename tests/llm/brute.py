"""Brute-force versions of the operators' results, in plain Python."""

import collections
import hashlib
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = SPACE_WORDS.findall(lower(t))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(rows):
    """(doc_id, set size, smallest linked id) of (doc_id, text) rows."""
    sets, up, by = [shingles(t) for _, t in rows], list(range(len(rows))), collections.defaultdict(list)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for k in s:
            by[k].append(i)
    for i, s in enumerate(sets):
        common = collections.Counter(j for k in s for j in by[k] if j > i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[top(i)].append(d)
    return sorted(((d, len(sets[i]), min(groups[top(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


NO_ID = -(1 << 63)


def repeats(rows, window=20):
    """(doc_id, words, removed, sha256 of the kept words); a null id is NO_ID."""
    texts = [(NO_ID if i is None else i, SPACE_WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone |= set(range(s, s + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def license_places(t):
    """Number of words and (place, label) of the base phrases."""
    w = LICENSE_WORDS.findall(lower(t))
    out = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(out)


def rule_counts(t):
    t = t or ""
    w = SPACE_WORDS.findall(t)
    n = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if SPACE_WORDS.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), lines]


def item_shingles(t):
    w = LICENSE_WORDS.findall((t or "").lower())
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def leaks(rows, items):
    """{(doc_id, item_id): best weighted similarity of an item-sized window}."""
    own = {(i, t): item_shingles(t) for i, t in set(items) if i is not None and item_shingles(t)}
    df = collections.defaultdict(set)
    for (i, _), s in own.items():
        for x in s:
            df[x].add(i)

    def weight(x):
        return max(1, 1000 // len(df[x])) if x in df else 1000

    out = {}
    for d, t in set(rows):
        s = item_shingles(t)
        for (i, _), x in own.items():
            a, m = set(x), len(x)
            wa = sum(map(weight, a))
            for k in range(max(1, len(s) - m + 1)):
                b = set(s[k:k + m])
                both = sum(map(weight, a & b))
                union = wa + sum(map(weight, b)) - both
                if a & b and 100 * both >= 75 * union:
                    out[d, i] = max(out.get((d, i), 0), round(both / union, 6))
    return out


def segments(scores):
    """Ruzzo and Tompa's recursive definition: the best segment, then both sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
               default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, a, b = best
    return segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in segments(scores[b:])]
