import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def find_root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text, size):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def jaccard(docs, size, percent):
    """doc_id -> (set size, smallest reachable doc_id), by comparing every pair."""
    sets = {d: shingles(t, size) for d, t in docs}
    ids, parent = sorted(sets), {d: d for d in sets}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find_root(parent, a), find_root(parent, b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find_root(parent, d)) for d in ids}


def sample_docs(seed=1, n=60):
    """Texts with copies, near copies, shared lines, nulls, blanks and junk; repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 6))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k)).capitalize() + "."
    shared = [line(9) for _ in range(3)]
    texts = []
    for i in range(n):
        r = rng.random()
        if texts and r < 0.15:
            t = rng.choice(texts)
        elif texts and r < 0.35:
            w = (rng.choice(texts) or "x").split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = "\n".join([line(rng.randint(20, 60)) for _ in range(rng.randint(1, 4))] + rng.sample(shared, rng.randint(0, 2)))
        texts.append(t)
    rows = [(i, t, "en", f"src{i % 6}", len(t)) for i, t in enumerate(texts)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, " \n\t", "en", None, 3), (n + 3, "one", "en", "src1", 3), (n + 4, "a | b # c " * 30, "en", "src2", 300)]
    return rows
