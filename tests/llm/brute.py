"""Plain versions of the operators over small inputs, and the awkward documents that tests share."""

import hashlib
import random
import re
from itertools import product

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lowered(text):
    return (text or "").translate(UPPER)


def plain(text):
    return PLAIN.findall(lowered(text))


def split(text):
    return WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Und", "ça", "thing", "re", "a", "I'm", "über,", "x9"]) + rng.choice(["", "ing", "er.", "ité"]) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text): prose, copies, near copies, shared passages, empty, null and odd texts."""
    rng = random.Random(seed)
    shared = [prose(rng, 70), prose(rng, 55), prose(rng, 120)]
    docs = []
    for i in range(n):
        kind = i % 6
        text = prose(rng, rng.choice([3, 20, 80, 200]))
        if kind == 1 and docs:
            text = rng.choice(docs)[1] or ""
        if kind == 2 and docs:
            words = (rng.choice(docs)[1] or "").split()
            if words:
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if kind == 3:
            text = prose(rng, 10) + "\n" + rng.choice(shared) + " " + prose(rng, 8) + "\t" + rng.choice(shared)
        docs.append((i, text))
    docs += [(n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "a " * 400), (n + 4, "a " * 300), (n + 5, "one"), (n + 6, "KK İ \x00   x")]
    docs.append((n + 7, prose(rng, 5000)))
    return docs


def fingerprint(text):
    words = [w for w in WORDS.findall(lowered(text))]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(prints, distance=4):
    """{id: fingerprint} to {id: least id reachable}."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in product(prints, prints):
        if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in prints}


def repeated_windows(docs, size=50):
    """{doc_id: [covered by a window that also starts in a smaller doc_id, for each word]}."""
    least = {}
    for i, text in sorted(docs):
        w = split(text)
        for at in range(len(w) - size + 1):
            least.setdefault(tuple(w[at : at + size]), i)
    out = {}
    for i, text in docs:
        w = split(text)
        gone = [False] * len(w)
        for at in range(len(w) - size + 1):
            if least[tuple(w[at : at + size])] < i:
                gone[at : at + size] = [True] * size
        out[i] = gone
    return out


def contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = plain(text)
        for at in range(max(1, len(w) - size + 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).add(str(item))
    lengths = sorted({len(w) for w in windows})
    out = {}
    for i, text in docs:
        w = plain(text)
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (k := tuple(w[at : at + n])) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[k]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out
