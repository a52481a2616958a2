"""Plain versions of the text operators, for small inputs."""

import collections
import hashlib
import re

import numpy as np
import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def personal(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return (*(sum(k == x[0] for x in out) for k in ("email", "ip", "card", "phone")), sha(",".join(f"{a}:{b}:{c}" for a, b, c in out)))


def secrets(t):
    t, out = t or "", []
    word = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    out.sort()
    return (*(sum(k == x[2] for x in out) for k in ("assign", "access", "hex")), sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in out)))


def licences(t):
    w, at, labels = PLAIN_WORD.findall(low(t or "")), [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def rules(t):
    t = t or ""
    w = SPACE_WORD.findall(t)
    n, seen, dup, covered = len(w), set(), 0, set()
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    for i in range(n - 2):
        if c[tuple(w[i : i + 3])] >= 2:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def windows(items):
    out = collections.defaultdict(set)
    for i, t in items:
        if w := PLAIN_WORD.findall(low(t or "")):
            for j in range(max(1, len(w) - 7)):
                out[tuple(w[j : j + 8])].add(str(i))
    return out


def leaks(t, wins):
    w, hit, items = PLAIN_WORD.findall(low(t or "")), set(), set()
    for m in {len(k) for k in wins}:
        for i in range(len(w) - m + 1):
            if (k := tuple(w[i : i + m])) in wins:
                items |= wins[k]
                hit |= set(range(i, i + m))
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), len(items) >= 2


def fingerprint(t, k=3):
    w = SPACE_WORD.findall(low(t or ""))
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))], dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def groups(rows, radius=2):
    """rows: (doc_id, fingerprint); the places of each component's rows."""
    left, out = list(range(len(rows))), []
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= radius]
            todo += near
            left = [j for j in left if j not in near]
        out.append(group)
    return out


def components(rows, radius=2):
    """rows: (doc_id, fingerprint); the least id of each row's component."""
    root = [None] * len(rows)
    for group in groups(rows, radius):
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        for i in group:
            root[i] = least
    return root


def repeats(rows, least=200):
    """rows: (doc_id, text); a counter of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = collections.Counter(), collections.Counter()
    coded = [(d, (t or "").encode()) for d, t in rows]
    for _, b in coded:
        seen.update(b[i : i + least] for i in range(len(b) - least + 1))
    for d, b in coded:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out[(d, len(b), sum(gone), runs, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y)))] += 1
    return out


def maximal_repeats(rows, least=200):
    """rows: (doc_id, text); {(length, occurrences (doc_id, start))} of the strings of at least that many bytes that occur twice and can't be made longer with all of their occurrences."""
    coded = [(d, t.encode()) for d, t in rows]
    suffixes = sorted((b[i:], k, i) for k, (_, b) in enumerate(coded) for i in range(len(b)))
    lcp = [0] * (len(suffixes) + 1)
    for j in range(1, len(suffixes)):
        a, b = suffixes[j - 1][0], suffixes[j][0]
        lcp[j] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    out = set()
    for j in range(1, len(suffixes)):
        v, lo, hi = lcp[j], j - 1, j
        if v < least:
            continue
        while lcp[lo] >= v and lo > 0:
            lo -= 1
        while lcp[hi + 1] >= v:
            hi += 1
        places = [(k, i) for _, k, i in suffixes[lo : hi + 1]]
        before = {coded[k][1][i - 1] if i else -1 - n for n, (k, i) in enumerate(places)}
        if len(before) > 1:
            out.add((v, frozenset((coded[k][0], i) for k, i in places)))
    return out


def shingles(t, k=5):
    w = SPACE_WORD.findall(low(t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar(rows, least=0.8):
    """rows: (doc_id, text); {(i, j): similarity} of all pairs of places with at least that Jaccard similarity."""
    sets, out = [shingles(t) for _, t in rows], {}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)):
                s = len(a & b) / len(a | b) if a or b else 1.0
                if s >= least:
                    out[j, i] = s
    return out
