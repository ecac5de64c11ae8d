"""Plain versions of the corpus stages, for small tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def line_removals(texts: list[str], t: float = 0.8) -> list[set[int]]:
    """Of texts in order, the numbers of the lines that match an earlier one."""
    seen: list[frozenset] = []
    out = []
    for text in texts:
        gone = set()
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(line.split())
            if words:
                if any(jaccard(words, s) >= t - 1e-12 for s in seen):
                    gone.add(k)
                seen.append(words)
        out.append(gone)
    return out


def shingle_counts(text: str) -> Counter:
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(x: Counter, y: Counter) -> float:
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[i] / x[d], y[i] / y[d]) for i in keys) for d in set(x) & set(y))


def near_classes(texts: list[str], t: float = 0.8) -> list[int]:
    """The first text of each one's class."""
    sets = [shingle_counts(x or "") for x in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (set(sets[i]) & set(sets[j]) and probability_jaccard(sets[i], sets[j]) >= t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def mix(rows: list[tuple[int, str, str | None]], share=1.5, most=2.0) -> dict[int, int]:
    """Words that the mix takes of rows of key, text and source."""
    size = {k: len((t or "").split()) for k, t, _ in rows}
    by = defaultdict(list)
    for k, t, s in rows:
        by[s].append((k, t or ""))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[k] for k, _ in by[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= full
    taken = {}
    for s in order:
        epochs, words = int(target[s] // total[s]) if total[s] else 0, 0
        rest = round(target[s] - epochs * total[s])

        def key(r):
            u = (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            n = size[r[0]]
            return -math.log(u) / (0.5 + 1 / (1 + abs(len(r[1]) / n - 5.5)) if n else 1.0)

        for k, _ in sorted(by[s], key=key):
            taken[k] = epochs * size[k] + max(0, min(size[k], rest - words))
            words += size[k]
    return taken


def mixed_texts(text: str, taken: int) -> list[str]:
    """A text as often as the mix takes it."""
    words = text.split()
    whole, rest = divmod(taken, len(words)) if words else (0, 0)
    return [text] * whole + ([" ".join(words[:rest])] if rest else [])
