"""Plain versions of the operators over Python rows, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\v\f\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def counts(text):
    text = text or ""
    w = words(text)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often, covered, seen, dup = Counter(g), set(), set(), 0
    for i, x in enumerate(g):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def line_dedup(rows, min_docs=5, min_chars=40):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, kept text)."""
    def key(line):
        return line.strip(WS).translate(UP)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, n):
    w = words((text or "").translate(UP))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def near_groups(rows, n=3, percent=90):
    """rows: (doc_id, text) with ids that are not null -> component of each row."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def substring(rows, window=20):
    """rows: (doc_id, text), distinct ids -> (doc_id, n_words, n_removed, kept)."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            if x in seen:
                gone |= set(range(i, i + window))
            seen.add(x)
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: {source: words} -> {source: target} by sharing the excess again and again."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        t = {s: cap * sizes[s] if s in capped else rest * w[s] / share for s in names}
        over = {s for s in names if s not in capped and t[s] > cap * sizes[s]}
        if not over:
            return t
        capped |= over


def mix(rows):
    """rows: (doc_id, source, text) -> {row number: words taken}."""
    size = [len(words(t)) for _, _, t in rows]
    per = defaultdict(int)
    for (_, s, _), n in zip(rows, size):
        per[s] += n
    goal, left, out = targets(per), {}, {}
    for s, n in per.items():
        left[s] = (round(goal[s]) // n, round(goal[s]) % n) if n else (0, 0)
    rest = {s: x[1] for s, x in left.items()}

    def key(i):
        d = rows[i][0]
        return hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], size[i]
    for i in sorted(range(len(rows)), key=key):
        s = rows[i][1]
        part = min(size[i], max(0, rest[s]))
        rest[s] -= size[i]
        out[i] = left[s][0] * size[i] + part
    return out
