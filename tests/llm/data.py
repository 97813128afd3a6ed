"""Small awkward tables and brute-force forms of the operators."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: doc_id, text, lang, source, n_chars and columns named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, digest string, size long, doc string, row long, score double, a string, b string, raw string, _nth int, _key string"


def awkward(seed: int = 0, n: int = 40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    passages = [[rng.choice(words) for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(n):
        w = list(rng.choice(passages))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), rng.choice(["s1", "s2", None, "Ä"])))
    rows += [(100, None, "s1"), (101, "", None), (102, " \t\n", "s2"), (103, "one two", "s1"), (104, "One TWO", "s1"), (None, "null id text here now ok", "s2"), (None, None, None)]
    rows += [(105, "long " + " ".join(rng.choice(words) for _ in range(20000)), "s3"), (106, "é中文 <|endoftext|> it's 42", "s1"), (106, "é中文 <|endoftext|> it's 42", "s1"), (0, rows[0][1], "s9")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 5, "k", "d", 1, "x", 2, 0.5, "a", "b", "r", 3, "kk") for d, t, s in rows], SCHEMA)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked(sets, percent=80):
    """The least index of each set's group."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j]:
                both = len(s & sets[j])
                if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def without_repeats(texts, length):
    """What is left of each text, and the number of runs that go."""
    count: dict[bytes, int] = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(g and not before for g, before in zip(gone, [False, *gone]))))
    return out
