"""Small tables with hard cases, and plain versions of the operators."""

import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside.
CLASHING = ["id", "node", "name", "key", "run", "sha", "score", "comp", "label", "blob", "path", "slot", "root", "_llm_id"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)


def docs(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, *["x"] * len(CLASHING)) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.repartition(parts) if full else df


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def classes(texts, similarity=0.8):
    """id -> least id of its class, by comparing every pair that shares a shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    where = {}
    for k, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(k)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in sets.items():
        for j, both in Counter(j for g in s for j in where[g] if j < k).items():
            if both >= similarity * (len(s) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((find(k), find(j)))
                root[b] = a
    return {k: find(k) for k in sets}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def near(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)
