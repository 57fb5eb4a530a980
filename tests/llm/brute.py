"""Plain versions of the operators, for small inputs."""

import re


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))


def shingle_set(text, k):
    w = spaced_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard_components(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows)]


def contamination(docs, items, span=13):
    windows = {}
    for key, text in items:
        w = alnum_words(text)
        for j in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + span]), set()).add(str(key))
    out = []
    for key, text in docs:
        w, hit, names = alnum_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                found = windows.get(tuple(w[j : j + size]))
                if found:
                    hit |= set(range(j, j + size))
                    names |= found
        out.append((key, len(w), len(hit), sorted(names)))
    return out
