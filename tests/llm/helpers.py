"""Small tables and brute-force versions that the operators are held against."""

import random


def words(text):
    return (text or "").encode().split()


def components(ids, linked):
    """Least id reachable from each position."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        root[find(i)] = find(j)
    best = {}
    for i, x in enumerate(ids):
        r = find(i)
        best[r] = x if best.get(r) is None else best[r] if x is None else min(best[r], x)
    return [best[find(i)] for i in range(len(ids))]


def corpus(seed=0, n=60):
    """Rows (doc_id, text): random texts with exact and near copies, shared passages, odd and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Émile", "ÀÉ", "İstanbul", "日本", "a\u00a0b", "x" * 300]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = make(60)
    texts = [None, "", " \t\n", "one", "one two", "One Two", "one two three", "ONE  two\nthree", "in. " * 3000, "a b c d", "A B C D", "a b c d e"]
    for _ in range(n):
        base = make(rng.choice((5, 12, 13, 14, 40, 90)))
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 6))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice((" ", "\n", "  ")).join(copy))
        if rng.random() < 0.3:
            texts.append(" ".join(make(rng.randrange(30)) + passage + make(rng.randrange(30))))
    texts.append(" ".join(make(20_000)))
    rng.shuffle(texts)
    return list(enumerate(texts))
