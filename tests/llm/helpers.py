"""Brute-force versions of the training-data operators, and fixtures with every awkward row."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def tokens(text):
    return NONSPACE.findall(lower(text))


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def windows(benchmark):
    found = {}
    for item, text in benchmark:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            found.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    return found


def contamination(text, found):
    w, hit, items = words(text), set(), set()
    for k in {len(z) for z in found}:
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in found:
                hit.update(range(i, i + k))
                items |= found[tuple(w[i : i + k])]
    return len(w), len(hit), sorted(items)


def components(sets, threshold=80):
    ids, parent = sorted(sets), {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


def documents(seed=1):
    """(doc_id, text, lang, source, n_chars): copies, chains of near copies, long, tiny, null and blank texts."""
    rng = random.Random(seed)
    base, long_ = prose(rng, 120), prose(rng, 6000)
    texts = [base, base, base.upper().lower(), long_, None, "", " \n\t ", "Ä", "one", "one two three", "one two three", "x " * 50]
    edited = base.split(" ")
    for _ in range(8):  # a chain: each link is close, the ends are not
        edited = list(edited)
        edited[rng.randrange(len(edited))] = prose(rng, 1)
        texts.append(" ".join(edited))
    for _ in range(12):  # a star of edits of one text, some too far from each other
        e = base.split(" ")
        for _ in range(rng.randint(0, 5)):
            e[rng.randrange(len(e))] = prose(rng, 1)
        texts.append(" ".join(e))
    texts += [prose(rng, rng.randint(20, 200)) for _ in range(14)] + [long_ + " tail"]
    return [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s2", "s2", None)[i % 5], len(t) if t is not None else None) for i, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
