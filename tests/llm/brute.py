"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(texts, length):
    """Per text (n_bytes, n_removed, n_spans, sha256)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def first_kept(rows, length, n_words):
    """Texts of (id, text) rows, in their order, without what windows of bytes or words cover that start earlier, too."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = [False] * len(data)

        def look(window, a, z, gone=gone):
            if window in seen:
                gone[a:z] = [True] * (z - a)
            seen.add(window)

        for a in range(len(data) - length + 1):
            look(data[a : a + length], a, a + length)
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        for k in range(len(at) - n_words + 1):
            look(tuple(data[a:z] for a, z in at[k : k + n_words]), at[k][0], at[k + n_words - 1][1])
        kept, piece = [], b""
        for b, g in zip(data, gone, strict=True):
            if g:
                kept, piece = [*kept, piece], b""
            else:
                piece += bytes([b])
        out[i] = None if rows[i][1] is None else "".join(x.decode("utf-8", "ignore") for x in [*kept, piece])
    return [out[i] for i in range(len(rows))]


def shingles(text, n):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(rows, n, percent):
    """{(id, text)} to {index: (n_shingles, component)}; ids are not null."""
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return [(len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def secrets(text):
    """Base spans as (start, order, end)."""
    text = text or ""
    a = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def quality(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), n < 50 or 100 * len(at) > 50 * n
