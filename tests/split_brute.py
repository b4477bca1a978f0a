"""Units of a paragraph, sign by sign."""

import re

WHITE = " \t\r\n\v\f"


def shortened(word):
    letters, stops = sum(c.isalpha() for c in word), word.count(".")
    return bool(re.fullmatch("[A-Za-z.]{1,10}", word)) and word.endswith(".") and letters >= 2 and (stops >= 2 or letters <= 4)


def ends(t):
    """Places of signs that end a sentence."""
    out = set()
    for m in re.finditer(r"[^ \t\r\n\v\f]+", t):
        for i in range(m.start(), m.end()):
            decimal = 0 < i < len(t) - 1 and t[i - 1] in "0123456789" and t[i + 1] in "0123456789"
            if t[i] in "!?" or (t[i] == "." and not shortened(m[0]) and not decimal):
                out.add(i)
    return out


def terms(t):
    return len(re.findall("[0-9A-Za-z]+", t))


def units(t, heading=False):
    """[(start, stop)] in bytes"""
    n, marks = len(t.encode()), ends(t)
    if not t:
        return []
    if heading or n <= 220 or terms(t) <= 18 or (t.count("\n") >= 2 and n <= 320) or len(marks) <= 1:
        return [(0, n)]
    found, start, i = [], 0, 0
    while i <= len(t):
        if i in marks or i == len(t):
            e = min(i + 1, len(t))
            while i < len(t) and e < len(t) and t[e] in "\"')]}":
                e += 1
            while e < len(t) and t[e] in WHITE:
                e += 1
            if x := t[start:e].rstrip(WHITE):
                found.append((len(t[:start].encode()), len(t[:start].encode()) + len(x.encode()), terms(x)))
            start = i = e
            if e == len(t):
                break
        else:
            i += 1
    short = lambda r: r[1] - r[0] < 48 or r[2] < 6
    out = []
    for r in found:
        if out and out[-1][1] - out[-1][0] + r[1] - r[0] <= 220 and (short(out[-1]) or short(r)):
            out[-1] = (out[-1][0], r[1], out[-1][2] + r[2])
        else:
            out.append(r)
    return [r[:2] for r in out]
