"""Plain definitions of what the operators return."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(texts, k=4, num=85, den=100):
    """doc -> (set size, least doc reachable)."""
    sets = {d: shingles(t, k) for d, t in texts.items()}
    holders, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        common = Counter(o for g in sets[d] for o in holders[g])
        for o, n in common.items():
            if den * n >= num * (len(sets[o]) + len(sets[d]) - n):
                a, b = sorted((root(o), root(d)))
                parent[b] = a
        for g in sets[d]:
            holders[g].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def quality_counts(t):
    w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def contamination(texts, items, width=10):
    owners = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            owners[tuple(w[k : k + width])].add(i)
    out = {}
    for d, t in texts.items():
        w, found = ALNUM.findall(lower(t)), set()
        hit = [False] * len(w)
        for n in {len(k) for k in owners}:
            for k in range(len(w) - n + 1):
                o = owners.get(tuple(w[k : k + n]))
                if o:
                    found |= o
                    hit[k : k + n] = [True] * n
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit))
    return out


def long_matches(texts, length=100):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def interactions(rows, labels):
    """rows: (doc_id, text, part); labels: (doc_id, quality, toxic). (part, order, step) -> kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in (0, 1))
    least, parts = {}, defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        parts[part or ""].append((d, {f for f, x in fails.items() if x}))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for o in map("".join, permutations("ABCDE")):
            for k, f in enumerate(o):
                before = set(o[:k])
                removed = [d for d, x in docs if f in x and not x & before]
                shapley[f] += len(removed)
                out[part, o, k + 1] = [sum(not x & (before | {f}) for _, x in docs), len(removed), sum(f in x and bool(x & before) for _, x in docs), sum(x == {f} for _, x in docs), sum(d in good for d in removed), sum(d in toxic for d in removed), f]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return out


def lloyd(vectors, k=40, rounds=5, size=64, scale=256):
    """vectors: (vec_id, components). (vec_id, cluster, distance, cluster_inertia, inertia, centroid hash) of each that is kept."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign() if cents else []
    inertia = Counter()
    for d, j in near:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, j, d, inertia[j], sum(inertia.values()), names[j]) for (i, _), (d, j) in zip(kept, near)]
