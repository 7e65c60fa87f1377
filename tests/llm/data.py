"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, ws, k):
    ws = list(ws)
    for i in rng.sample(range(len(ws)), k):
        ws[i] = f"x{rng.randrange(10**6)}"
    return ws


def near_rows(seed=3):
    """Groups of near and exact copies, chains of them, and odd rows."""
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(12):
        base = words(rng, 60 + 10 * g, 5000)
        for k in (0, 0, 1, 2, 3, 4):
            rows.append((100 - n, " ".join(edited(rng, base, k))))
            n += 1
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "a b"), (1004, "A  b"), (1005, "a b c"), (1006, "b a"), (1007, "é É"), (1008, "é É"), (None, "a b")]
    rows.append((1009, " ".join(words(rng, 20000, 50))))
    rows.append(rows[0])
    return [(d, t, "en", "s", len(t or "")) for d, t in rows]


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets, percent=75):
    """Smallest id reachable, for a dict of id to a set."""
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in sets}
