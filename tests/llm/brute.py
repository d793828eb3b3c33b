"""Slow versions from the definitions."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    t, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def quality(text):
    t = text or ""
    words, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(grams) < 3000 else None
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, None if marked is None else len(marked)


def suffix(rows):
    seen, out = {}, []
    for d, t in rows:
        raw = (t or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if seen.setdefault(raw[i : i + 100], (d, i)) != (d, i):
                cut[i : i + 100] = b"\1" * 100
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        out.append((d, len(raw), sum(cut), sum(cut[i] and (i == 0 or not cut[i - 1]) for i in range(len(cut))), sha(kept)))
    return out


def windows13(rows):
    seen, out = {}, []
    for d, t in rows:
        words = WORD.findall(t or "")
        cut = [False] * len(words)
        for i in range(len(words) - 12):
            if seen.setdefault(tuple(words[i : i + 13]), d) < d:
                cut[i : i + 13] = [True] * 13
        out.append((d, len(words), sum(cut), sha(" ".join(w for w, c in zip(words, cut) if not c))))
    return out


def components(rows, percent=85):
    sets = {}
    for d, t in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return [(d, len(sets[d]), root(d), root(d) == d) for d in ids]
