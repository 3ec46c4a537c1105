"""Plain reference computations for the tests of this folder."""

import random

WORDS = [f"w{i}" for i in range(400)]


def split(text):
    return (text or "").encode().split()


def jaccard_classes(rows, k, percent):
    """{row number: (n_shingles, component, links)} of (key, text) rows by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                label[max(find(i), find(j))] = min(find(i), find(j))
    keys = {}
    for i, (key, _) in enumerate(rows):
        keys.setdefault(find(i), []).append(key)
    return [(rows[i][0], len(sets[i]), min((x for x in keys[find(i)] if x is not None), default=None) if sets[i] else rows[i][0], links[i])
            for i in range(len(rows))]


def near_copies(seed=1, families=6, size=25, length=60):
    """Families of texts with a few edits, exact copies, short and empty texts, and one passage in many texts."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    texts = ["", None, "  \t ", "One", "one", "one two", "ONE two", "a b c", "a b c a b c a b c"]
    for f in range(families):
        base = [rng.choice(WORDS) for _ in range(length * (f + 1))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    for _ in range(40):
        texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 15))) + " " + passage)
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]
