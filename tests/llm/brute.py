"""Plain Python versions of the corpus operators for small inputs."""

import re


def shingles(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def roots(links, ids):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs, percent=80):
    """docs: (doc_id, text) with unique ids; doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    by_value = {}
    for i in ids:
        for s in sets[i]:
            by_value.setdefault(s, []).append(i)
    counts = {}
    for members in by_value.values():
        for x, a in enumerate(members):
            for b in members[x + 1 :]:
                counts[a, b] = counts.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in counts.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    top = roots(links, ids)
    return {i: (len(sets[i]), top[i]) for i in ids}
