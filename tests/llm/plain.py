"""The operators once more, plainly and for small tables, to hold results against."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def groups(docs, k, percent):
    """The shingle sets of (doc_id, text) rows, and for each row the number of its component, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(docs))]


def components(docs, k, percent):
    """[(doc_id, set size, component)] of (doc_id, text) rows."""
    sets, roots = groups(docs, k, percent)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if sets[i] and doc_id is not None:
            least[roots[i]] = min(least.get(roots[i], doc_id), doc_id)
    return [(d, len(s), least.get(roots[i], d) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def one_of_each(docs, k, percent):
    """The rows that stay: of each component the one with the smallest id, no id last; all without shingles."""
    sets, roots = groups(docs, k, percent)
    best = {}
    for i, (d, _) in enumerate(docs):
        if sets[i]:
            best[roots[i]] = min(best.get(roots[i], (True, float("inf"), i)), (d is None, d if d is not None else 0, i))
    return [i for i in range(len(docs)) if not sets[i] or best[roots[i]][2] == i]


def contamination(text, items, size=13):
    """(words, words hit, ids of the items with an occurring window)."""
    w = item_words(text)
    hit, found = set(), set()
    for item, body in items:
        b = item_words(body)
        n = min(len(b), size)
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(item)
    return len(w), len(hit), {str(x) for x in found if x is not None}


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), cap=2):
    """Target by source, resharing what is above a cap until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > cap * sizes[s]}
        out |= {s: Fraction(cap * sizes[s]) for s in over} if over else part
        free = free - over if over else set()
    return out


def kneser_ney(train, texts, discounts):
    """log10 probability of each text under the interpolated bigram model."""
    tokens = lambda t: [*words(t), None]
    pairs = Counter(p for t in train for p in zip(["<s>", *tokens(t)], tokens(t)))
    d = discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    contexts = Counter(b for _, b in pairs)
    e = discounts([sum(c == k for c in contexts.values()) for k in (1, 2, 3, 4)])
    total, rest = Counter(), defaultdict(float)
    for (a, _), c in pairs.items():
        total[a] += c
        rest[a] += d[min(c, 3)]
    spare, v = sum(e[min(c, 3)] for c in contexts.values()), len(contexts)

    def lower(w):
        return (max(contexts[w] - e[min(contexts[w], 3)], 0) + spare / (v + 1)) / len(pairs) if pairs else 1 / (v + 1)

    def chance(h, w):
        if not total[h]:
            return lower(w)
        c = pairs[h, w]
        return (max(c - d[min(c, 3)], 0) + rest[h] * lower(w)) / total[h]

    return [sum(math.log10(chance(h, w)) for h, w in zip(["<s>", *tokens(t)], tokens(t))) for t in texts], contexts, chance
