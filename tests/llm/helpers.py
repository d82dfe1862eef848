"""Small corpora and plain re-computations for the tests of the training-data operators."""

import collections
import random
import re

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, size string, v int, copies int, hits int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def make_docs(spark, rows, parts=3):
    """Documents from (id, text) or (id, text, source), with extra columns whose names operators use inside."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", 7, 8, 9) for r in rows]
    return spark.createDataFrame(full, AWKWARD).repartition(parts)


def collected(df, *names):
    """Sorted tuples of the named columns."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def prose(seed, words, vocabulary=400):
    """Words that look random, the same for one seed."""
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def alnum_words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_counts(text):
    words = alnum_words(text)
    return collections.Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def weighted_jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def groups(nodes, linked):
    """Least node that links reach, per node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
