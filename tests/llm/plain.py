"""Plain versions of what the operators compute, for small inputs."""

import math
import re
from collections import Counter


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(ids, links):
    """Smallest id reachable from each id."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def near(texts, width, percent=80):
    """{id: (set size, component)} of {id: text}."""
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = components(ids, links)
    return {i: (len(sets[i]), low[i]) for i in ids}


ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, window=13):
    """(words, hit words, sorted items) of a text."""
    low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    w, hit, found = ITEM_WORD.findall(low(text)), set(), set()
    for item, t in items:
        v = ITEM_WORD.findall(low(t))
        k = min(window, len(v))
        runs = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in runs:
                found.add(str(item))
                hit |= set(range(i, i + k))
    return len(w), len(hit), sorted(found)


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def best_segmentation(word, scores, byte_score):
    """(pieces, score) of the best segmentation of a marked word, by trying every cut."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * byte_score, -best[end - 1][1] - n))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1], best[-1][0]


def base_scores(texts, train):
    """{id: (tokens, known, base score)} and the number of training tokens."""
    counts = Counter()
    for i in train:
        counts.update([*words(texts[i]), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in texts.items():
        w = [*words(t), None]
        out[i] = (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out, n


def passages(texts, paragraph_words, passage_words, window, order):
    """Clusters of (id, first word, words, removed) of repeated units, by all pairs; order(five words) ranks runs for anchors."""
    units = []
    for i, t in texts.items():
        w, at = words(t), 0
        for line in (t or "").split("\n"):
            n = len(words(line))
            if n >= paragraph_words:
                units.append((i, at, n, (0, *w[at : at + n])))
            at += n
        rank = [order(w[k : k + 5]) for k in range(len(w) - 4)]
        found = {min(range(k, k + window), key=lambda x: (rank[x], -x)) for k in range(len(rank) - window + 1)}
        units += [(i, k, passage_words, (1, *w[k : k + passage_words])) for k in sorted(found) if k + passage_words <= len(w)]
    names = sorted({u[3] for u in units})  # paragraphs (0) and passages (1) are compared apart
    number = {x: k for k, x in enumerate(names)}
    sets = [frozenset((x[0], *x[k : k + 5]) for k in range(1, len(x) - 4)) for x in names]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low, docs = components(range(len(sets)), links), {}
    for i, _, _, x in units:
        docs.setdefault(low[number[x]], set()).add(i)
    hits = sorted((i, i != min(docs[u]), at, n, u) for i, at, n, x in units for u in [low[number[x]]] if len(docs[u]) > 1)
    spans, of = [], {}
    for i, gone, at, n, u in hits:
        if spans and spans[-1][:2] == [i, gone] and at <= spans[-1][3]:
            spans[-1][3] = max(spans[-1][3], at + n)
        else:
            spans.append([i, gone, at, at + n])
        of.setdefault(u, []).append(len(spans) - 1)
    joined = components(range(len(spans)), [(x[0], y) for x in of.values() for y in x])
    out = {}
    for k, (i, gone, a, b) in enumerate(spans):
        out.setdefault(joined[k], set()).add((i, a, b - a, gone))
    return {frozenset(x) for x in out.values()}


def hidden_path(word_scores, letters, langs, penalty):
    """(language, letters of it) by trying every labelling of the words."""
    import itertools

    best = max(itertools.product(range(len(langs)), repeat=len(word_scores)), key=lambda p: sum(s[x] for s, x in zip(word_scores, p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
    share = Counter()
    for x, n in zip(best, letters):
        share[x] += n
    top = max(range(len(langs)), key=lambda x: (share[x], -x))
    return langs[top], share[top]
