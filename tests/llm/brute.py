"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import defaultdict

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(ASCII_LOWER))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def roots(nodes, links):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text, k):
    w = SPACED.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, k, most):
    fps = {i: fingerprint(t, k) for i, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= most]
    return {i: (fps[i], r) for i, r in roots(fps, links).items()}


def similar(rows, k=5, least=0.8):
    """{id: root} over texts whose sets of k-word shingles have at least this similarity."""

    def shingles(text):
        w = (text or "").split()
        return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: a == b or (min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b))
    return roots(sets, [(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])])


def contamination(docs, tests, window):
    wins = defaultdict(set)
    for item, t in tests:
        w = alnum(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[s : s + window])].add(item)
    out = {}
    for i, t in docs:
        w, hit, items = alnum(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if got := wins.get(tuple(w[s : s + n])):
                    items |= got
                    hit |= set(range(s, s + n))
        out[i] = (len(w), len(hit), sorted(map(str, items)))
    return out


def near_lines(a, b, threshold, long):
    """Within ``threshold`` characters; two lines of ``long`` words or more within so many words."""
    x, y = a.split(" "), b.split(" ")
    if min(len(x), len(y)) < long:
        x, y = a, b
    return abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold


def lines_left(rows, threshold, least, long):
    """{id: text}: a line goes if one within the threshold comes before it, by id and number."""
    seen, out = {}, {}
    for i, t in sorted(r for r in rows if r[1] is not None):
        kept = []
        for line in t.split("\n"):
            key = line.strip(" ")
            if len(key) < least:
                kept.append(line)
                continue
            if key not in seen and not any(near_lines(key, s, threshold, long) for s in seen):
                kept.append(line)
            seen[key] = True
        out[i] = "\n".join(kept)
    return out


def base_places(text, phrases):
    w, out = alnum(text), []
    for label, phrase in phrases:
        p = alnum(phrase)
        out += [(label, s) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
    return len(w), out


