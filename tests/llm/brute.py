"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    found = [(m.start(), KINDS.index(k), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if good(k, m[0])]
    return sorted(found)


def base_row(text):
    spans = base_spans(text)
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return [sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(said.encode()).hexdigest()


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, n):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_components(texts, n, percent):
    """Component number of every text, by comparing all pairs."""
    sets = [shingle_set(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def best_tiles(item, doc, least):
    """Greedy tiling by looking at every pair of positions; returns the words covered."""
    item_free, doc_free, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item_free[i + n] and doc_free[d + n] and item[i + n] == doc[d + n] != 0:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return covered
        for k in range(n):
            item_free[i + k] = doc_free[d + k] = False
        covered += n


def tree_paths(messages):
    """Root-to-leaf paths of one conversation: (score, leaf, path) best first."""
    known = {m: (p, s) for m, p, s in messages}
    inner = {p for p, _ in known.values()}
    found = []
    for leaf in known:
        if leaf in inner:
            continue
        path, at, total = [], leaf, 0.0
        while at in known:
            path.append(at)
            total += known[at][1]
            at = known[at][0]
        found.append((-total, leaf, path[::-1]))
    return sorted(found)
