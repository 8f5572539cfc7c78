"""Plain versions of the operators for small tables."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def substring(rows, window=35):
    at = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if at[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed=1):
    """Documents with copies, near copies, shared passages, repeats inside, short, empty, null and long ones."""
    r = random.Random(seed)
    make = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    base, passage = make(300), make(60)
    docs = [" ".join(base)] * 3
    for k in range(25):
        w = list(base)
        for _ in range(r.randrange(1, 14)):
            w[r.randrange(len(w))] = f"x{k}"
        docs.append(" ".join(w))
    docs += [" ".join(make(40) + passage + make(r.randrange(5, 60))) for _ in range(6)]
    own = make(50)
    docs += [" ".join(own + make(10) + own), " ".join(["so"] * 90), None, "", " \n ", "a b", "A B", "one", " ".join(make(5000)), "É è\tç d e f g", "\n".join(" ".join(make(12)) + "." for _ in range(20))]
    return [(10 * i + 3, t) for i, t in enumerate(docs)]
