"""Slow and plain versions of the operators, to hold results against."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grouped(n: int, edges) -> list[int]:
    """Least index of each of n nodes' components."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def edit(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def licenses(text: str | None, templates, least: float = 0.75) -> list[tuple[str, int]]:
    """(name, equal words) by an alignment of each whole template with the whole text, one per text and template."""
    out = []
    w = words(text)
    for name, template in templates:
        marked = re.findall(r"(\{?)([a-z0-9\u0080-\U0010ffff]+)", template.lower())
        t, required = [x for _, x in marked], {n for n, (brace, _) in enumerate(marked) if brace}
        best = [(0, 0, frozenset())] * (len(w) + 1)  # score, equal words, the equal ones
        for place, x in enumerate(t):
            now = [(best[0][0] - 1, best[0][1], best[0][2])]
            for j, y in enumerate(w, 1):
                s, n, m = best[j - 1]
                d = (s + 2, n + 1, m | {place}) if x == y else (s - 1, n, m)
                up, left = best[j], now[j - 1]
                now.append(max(d, (up[0] - 1, up[1], up[2]), (left[0] - 1, left[1], left[2]), key=lambda v: v[0]))
            best = now
        s, n, m = max(best, key=lambda v: (v[0], v[1]))
        if n >= least * len(t) and required <= m:
            out.append((name, n))
    return out


SENTENCE = re.compile(r"[.!?](?=\s|$)|[.!?](?=[\"')\]](?:\s|$))|\n")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; a piece without words belongs to the one before."""
    out, at = [], 0
    for m in [*SENTENCE.finditer(text.lower()), None]:
        end = m.start() if m else len(text.lower())
        if w := words(text.lower()[at:end]):
            out.append(w)
        at = m.end() if m else end
    return out


def repeated_sentences(docs: list[tuple], least: int, alone: int) -> dict[tuple, set[int]]:
    """(id, text) -> numbers of the sentences that any non-first occurrence of a run of two sentences or more and
    ``least`` words, or of a sentence of ``alone`` words, covers.

    Every run of whole sentences is looked at; equal (id, text) rows are one document.
    """
    seen: dict[tuple, list] = {}
    every = {}
    for key in dict.fromkeys((i, t) for i, t in docs if t):
        s = sentences(key[1])
        every[key] = s
        for a in range(len(s)):
            run: list[str] = []
            for e in range(a + 1, len(s) + 1):
                run = run + s[e - 1]
                if len(run) >= (alone if e == a + 1 else least):
                    seen.setdefault(tuple(run), []).append((key, a, e))
    order = {k: n for n, k in enumerate(sorted(every, key=lambda k: (k[0] is not None, k[0] or 0)))}
    gone: dict[tuple, set[int]] = {}
    for places in seen.values():
        first = min(places, key=lambda p: (order[p[0]], p[1]))
        for p in places:
            if p != first:
                gone.setdefault(p[0], set()).update(range(p[1], p[2]))
    return gone


def near_groups(sigs: list[bytes], k: int) -> list[int]:
    v = [int.from_bytes(s, "little") for s in sigs]
    return grouped(len(v), ((i, j) for i in range(len(v)) for j in range(i) if (v[i] ^ v[j]).bit_count() <= k))


def line_groups(forms: list[str], least: float, min_bytes: int = 20) -> list[int]:
    """Components of normal forms that are equal, or have ``min_bytes`` bytes and edit similarity ``least``."""

    def near(a, b):
        most = (1 - least) * max(len(a), len(b)) + 1e-9
        return a == b or min(len(a.encode()), len(b.encode())) >= min_bytes and abs(len(a) - len(b)) <= most and edit(a, b) <= most

    return grouped(len(forms), ((i, j) for i in range(len(forms)) for j in range(i) if near(forms[i], forms[j])))


UNITS = set("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons tonnes ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years mph kmh percent dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit watt watts kw volt volts hz mb gb kb".split())


def canonical(text: str, template: bool) -> list[tuple[str, str]]:
    """(token, surface) of a text; slots are NUM, UNIT and NAME."""
    found = list(re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text))
    out: list[tuple[str, str]] = []
    for n, m in enumerate(found):
        w = m[0]
        gap = text[found[n - 1].end() : m.start()] if n else None
        kind = w.lower()
        if template:
            after_number = n and found[n - 1][0][0].isdigit()
            if w[0].isdigit():
                kind = "NUM"
            elif after_number and w.lower() in UNITS:
                kind = "UNIT"
            elif n and w[0].isupper() and not re.search(r"[\n!.:?]", gap) and not (len(w) > 1 and "A" <= w[1] <= "Z"):
                kind = "NAME"
            if kind in ("NUM", "NAME") and out and out[-1][0] == kind and gap is not None and len(gap) == 1:
                out[-1] = (kind, out[-1][1] + w.lower())
                continue
        out.append((kind, w.lower()))
    return out


def leaks(text: str | None, item: str | None, window: int = 8, least: int = 5, coverage: float = 0.5) -> bool:
    """Whether an item leaks into a text: windows are compared one by one."""
    for template in (True, False):
        d, q = canonical(text or "", template), canonical(item or "", template)
        if len(q) < least:
            continue
        size = min(window, len(q))
        hits = []
        for p in range(len(q) - size + 1):
            part = [x for x, _ in q[p : p + size]]
            if 2 * sum(x in ("NUM", "UNIT", "NAME") for x in part) > size:
                continue
            hits += [(k, p) for k in range(len(d) - size + 1) if [x for x, _ in d[k : k + size]] == part]
        slack = max(1, len(q) // 10)
        for shift in {k - p for k, p in hits}:
            cover: dict[int, int] = {}
            for k, p in sorted((h for h in hits if abs(h[0] - h[1] - shift) <= slack), key=lambda h: abs(h[0] - h[1] - shift)):
                for x in range(size):
                    cover.setdefault(p + x, k + x)
            if len(cover) < coverage * len(q):
                continue
            value: dict[str, str] = {}
            if all(value.setdefault(q[p][1], d[k][1]) == d[k][1] for p, k in cover.items() if q[p][0] in ("NUM", "UNIT", "NAME")):
                return True
    return False


def kernel(a: str, b: str, most: int = 4) -> float:
    """Blended-spectrum presence kernel of two texts."""

    def grams(t):
        data = ("" if not (w := words(t)) else " " + " ".join(w) + " ").encode()
        return {(n, data[i : i + n]) for n in range(1, most + 1) for i in range(len(data) - n + 1)}

    x, y = grams(a), grams(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0.0


def token_counts(texts) -> Counter:
    return Counter(w for t in texts for w in words(t))
