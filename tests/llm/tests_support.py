"""Plain versions that several tests use."""

import re

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near_groups(plain):
    """doc_id -> size of its shingle set, smallest doc_id reachable over links."""
    sets = {}
    for i, t in plain:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
