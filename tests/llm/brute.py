"""Plain Python versions of what the operators compute."""

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def quality_counts(text):
    t = text or ""
    w = SPACED.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = set()
    for at in places.values():
        if len(at) > 1:
            for i in at:
                hit |= {i, i + 1, i + 2}
    n = len(w)
    return (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


def without_repeats(docs):
    """doc_id -> (n_words, n_removed, sha256) for unique doc_ids."""
    words = {d: SPACED.findall(t or "") for d, t in docs}
    least = {}
    for d, w in words.items():
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near_components(docs, n=3, percent=90):
    """(doc_id, set size, component) for unique doc_ids, by all pairs."""
    sets = {}
    for d, t in docs:
        w = SPACED.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    top = {d: d for d in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by_gram = {}
    for d in ids:
        for g in sets[d]:
            by_gram.setdefault(g, []).append(d)
    seen = set()
    for own in by_gram.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (a, b) not in seen and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def unigram_base(rows):
    """rows (doc_id, text, held_out) -> doc_id -> (n_tokens, n_known, N, base); the end is one token."""
    import math
    from collections import Counter

    tokens = {d: [*SPACED.findall(lower(t)), None] for d, t, _ in rows}
    count = Counter(x for d, _, h in rows if not h for x in tokens[d])
    total, known = sum(count.values()), len(count)
    z = total + 0.5 * (known + 1)
    return {d: (len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 0.5) / z) for x in w)) for d, w in tokens.items()}


def bigram_score(rows, mu):
    import math
    from collections import Counter

    tokens = {d: [*SPACED.findall(lower(t)), None] for d, t, _ in rows}
    count, pair, context = Counter(), Counter(), Counter()
    for d, _, h in rows:
        if not h:
            count.update(tokens[d])
            pair.update(zip(["^", *tokens[d]], tokens[d]))
            context.update(["^", *tokens[d][:-1]])
    z = sum(count.values()) + 0.5 * (len(count) + 1)
    p = lambda u, w: (pair[u, w] + mu * (count[w] + 0.5) / z) / (context[u] + mu)
    return {d: sum(math.log10(p(u, w)) for u, w in zip(["^", *t], t)) for d, t in tokens.items()}
