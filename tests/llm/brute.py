"""Plain re-statements of the contracts, for small inputs."""

import re


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def white(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, k=5):
    w = white(lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, percent=80, k=5):
    """[(doc_id, text)] -> {doc_id: (n, smallest id)}"""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    seen = set()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    inter = len(sets[a] & sets[b])
                    if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contaminated(docs, items, k=10):
    """{doc_id: (n_words, n_hit, sorted item ids as strings)}"""
    grams = {}
    for i, t in items:
        w = alnum(t)
        for j in range(max(1, len(w) - k + 1) if w else 0):
            grams.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = {}
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if g := grams.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= g
        out[d] = (len(w), len(hit), sorted(found))
    return out


def longest(docs, items, k=10):
    """{(item_id, word): longest match of at least the window}"""
    texts, out = [alnum(t) for _, t in docs], {}
    for i, t in items:
        w = alnum(t)
        for j in range(len(w)):
            least = min(k, len(w))
            if j + least > len(w):
                continue
            n = max((next((m for m in range(len(w) - j + 1) if w[j : j + m + 1] != d[p : p + m + 1] or j + m == len(w)), 0) for d in texts for p in range(len(d))), default=0)
            if n >= least:
                out[(str(i), j)] = n
    return out


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def without_repeats(docs, k=50):
    """{doc_id: (n_words, kept text)}"""
    low = {}
    words = [(d, white(t)) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            low[g] = min(d, low.get(g, d))
    out = {}
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if low[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out[d] = (len(w), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def text_counts(t):
    t = t or ""
    w = white(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g in set(grams) if grams.count(g) > 1}
    hit = {i + j for i, g in enumerate(grams) if g in often for j in range(3)}
    lines = [x for x in t.split("\n") if white(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_upper": sum("A" <= c <= "Z" for c in t),
        "n_lines": len(lines), "n_stops": sum(c in ".!?" for c in t),
    }
