"""Brute-force versions that several tests share."""

import re


def near_duplicate_groups(texts: dict, width: int, percent: int) -> dict:
    """The smallest id that can be reached from each, by comparing all pairs."""
    sets = {}
    for k, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[k] = set(zip(*[words[i:] for i in range(width)])) if len(words) >= width else ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {k: find(k) for k in ids}


def contaminated(text: str, items: list, window: int = 10) -> bool:
    find = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words = find(text)
    for item in items:
        own = find(item)
        n = min(window, len(own))
        grams = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
        if any(tuple(words[p : p + n]) in grams for p in range(len(words) - n + 1)):
            return True
    return False
