"""Plain Python versions of what the pipeline operators must give."""

import hashlib
import re

JACCARD_WORD = re.compile("[^\x20\x09-\x0d]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Union:
    """Components named by their smallest member."""

    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text):
    w = JACCARD_WORD.findall(lower(text))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def jaccard_components(texts):
    """id -> (set size, component) for texts by id."""
    sets = {d: shingles(t) for d, t in texts.items()}
    union = Union(sets)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                union.join(a, b)
    return {d: (len(sets[d]), union.find(d)) for d in ids}


def contaminated(text, items, window=13):
    """(n_words, n_hit, n_items, digest of the items, contaminated)."""
    windows = {}
    for item, content in items:
        w = BENCH_WORD.findall(lower(content))
        for x in [tuple(w)] if 0 < len(w) < window else [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]:
            windows.setdefault(x, set()).add(str(item))
    w = BENCH_WORD.findall(lower(text))
    hit, found = set(), set()
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            if x in windows:
                hit.update(range(i, i + size))
                found |= windows[x]
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in out)
