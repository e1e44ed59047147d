"""Plain versions of the contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def word_repeats(docs, window=20):
    first, out = {}, []
    order = sorted(docs, key=lambda d: d[0])
    for doc, text in order:
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (doc, i))
    for doc, text in order:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc, i):
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return sorted(out)


def byte_repeats(docs, length=50):
    first, out = {}, []
    for doc, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, doc), doc)
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def near_groups(docs, percent=85):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for doc, text in docs:
        w = words((text or "").translate(lower))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    for d, s in sets.items():
        both = {}
        for x in s:
            for e in where[x]:
                if e < d:
                    both[e] = both.get(e, 0) + 1
        for e, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets.items())


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {x for x in wins if wins.count(x) > 1} if len(wins) < 400 else {x for x, n in __import__("collections").Counter(wins).items() if n > 1}
    covered = {j for i, x in enumerate(wins) if x in many for j in range(i, i + 5)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n
