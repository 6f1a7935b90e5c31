"""Brute-force versions that the operators are held against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text, n):
    w = words(text, lower=True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent):
    """{index: (set size, index of the component's first row)} for (doc_id, text) rows."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def without_repeats(texts, n):
    """(words, removed, kept text) of each text."""
    where = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone = {(d, i + k) for places in where.values() if len(places) > 1 for d, i in places for k in range(n)}
    out = []
    for d, t in enumerate(texts):
        w = words(t)
        kept = [x for i, x in enumerate(w) if (d, i) not in gone]
        out.append((len(w), len(w) - len(kept), " ".join(kept)))
    return out


def edits(pattern, text):
    """Least edits of the pattern to a substring that ends at each place of the text: the plain table."""
    column = list(range(len(pattern) + 1))
    out = []
    for x in text:
        last, column = column, [0]
        for i, p in enumerate(pattern):
            column.append(min(last[i] + (p != x), last[i + 1] + 1, column[i] + 1))
        out.append(column[-1])
    return out


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def near_copy(rnd, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
    return " ".join(w)


def rng(seed):
    return random.Random(seed)
