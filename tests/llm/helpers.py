"""Small tables and plain Python versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, base=400):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


def documents(rng, n=60):
    """Prose with copies, near copies, odd texts, nulls in every column, ties and repeated rows."""
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(1, 160))
        if i % 5 == 1 and rows:
            text = rows[-1][1]
        if i % 7 == 2 and rows and rows[-1][1]:
            near = rows[-1][1].split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), len(text)))
    odd = [None, "", " \n\t ", "\n", "one", "ONE", "é ü ß İ ſ x", "a\x0bb\x0cc\rd", "x" * 5000, prose(rng, 3000, 50), "line one is long\nline one is long\n\nline TWO is long  "]
    rows += [(n + i, t, "en", "a", 0) for i, t in enumerate(odd)]
    rows += [(n + 50, "line one is long\n  LINE two is long\nmore", None, None, None)] * 2
    rows += [(None, "line one is long\nwithout an id", "en", "a", 3)]
    return rows


def shingles(text, width=5):
    ws = words((text or "").translate(LOWER))
    if len(ws) < width:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)}


def near_groups(rows):
    """(doc_id, size, component, kept) by comparing all pairs; doc_ids are unique here."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def statistics(text):
    ws = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def line_dedup(rows):
    """Multiset of (doc_id, lines, dropped, kept text)."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    order = lambda d: (d is None, d or 0)
    owner, holders = {}, defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            holders[k].add(d)
            owner[k] = min(owner.get(k, d), d, key=order)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or owner[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)
