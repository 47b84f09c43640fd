"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return BLANK_WORD.findall(text or "")


def repeated_strings(docs, length=50):
    """{id: (n_bytes, n_removed, n_spans, kept bytes)} of documents with different ids."""
    first, out = {}, {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first.setdefault(data[s : s + length], i) < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


def repeated_runs(docs, window=20):
    """{id: (n_words, n_removed, kept text)} of documents with different ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        found = words(text)
        gone = [False] * len(found)
        for s in range(len(found) - window + 1):
            key = tuple(found[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(found), sum(gone), " ".join(w for w, g in zip(found, gone) if not g))
    return out


def passages(docs, items, window=10):
    """{id: (n_words, hit words, items)}."""
    windows = defaultdict(set)
    for item, text in items:
        found = ALNUM_WORD.findall(lower(text))
        for s in range(max(1, len(found) - window + 1) if found else 0):
            windows[tuple(found[s : s + window])].add(item)
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs:
        found = ALNUM_WORD.findall(lower(text))
        hit, met = [False] * len(found), set()
        for n in sizes:
            for s in range(len(found) - n + 1):
                if (owners := windows.get(tuple(found[s : s + n]))) is not None:
                    met |= owners
                    hit[s : s + n] = [True] * n
        out[i] = (len(found), sum(hit), met)
    return out


def shingles(text, n=5):
    found = words(lower(text))
    return {tuple(found[s : s + n]) for s in range(max(1, len(found) - n + 1))} if found else set()


def groups(docs, percent=75):
    """{id: (set size, smallest linked id)} of documents with different ids."""
    sets = {i: shingles(text) for i, text in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for member in s:
            holders[member].append(i)
    shared = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    found = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    runs = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    hit = [False] * len(found)
    for i in range(len(found) - 4):
        if runs[tuple(found[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    failed = len(found) < 10 or 100 * sum(hit) > 20 * len(found)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), sum(hit), failed


SECRETS = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_secrets(text):
    found = []
    for rank, (kind, pattern, keep) in enumerate(SECRETS):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if keep(m)]
    return [f"{kind}:{begin}:{stop}" for begin, _, kind, stop in sorted(found)]
