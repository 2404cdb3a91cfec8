import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pulse.llm import near_dup

from . import data


def lcs(x, y):
    before = [0] * (len(y) + 1)
    for a in x:
        now = [0]
        for j, b in enumerate(y):
            now.append(before[j] + 1 if a == b else max(before[j + 1], now[j]))
        before = now
    return before[-1]


def grams(text):
    w = (text or "").lower().split()
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def linked(a, b):
    x, y = grams(a), grams(b)
    if not x or not y:
        return len(x) == len(y)
    m = lcs(x, y)
    return m >= 0.8 * (len(x) + len(y) - m) - 1e-9


def brute(texts):
    of = list(range(len(texts)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if linked(texts[i], texts[j]):
                of[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def partition(labels):
    by = defaultdict(set)
    for i, x in labels:
        by[x].add(i)
    return sorted(map(sorted, by.values()))


def test_alignment_equals_plain_lcs():
    r = random.Random(0)
    for _ in range(300):
        x = [r.randint(0, r.choice([2, 5, 30])) for _ in range(r.randint(0, 40))]
        y = list(x)
        for _ in range(r.randint(0, 8)):
            if y and r.random() < 0.5:
                y.pop(r.randrange(len(y)))
            else:
                y.insert(r.randint(0, len(y)), r.randint(0, 30))
        assert near_dup.common_in_order(x, y, 100) == lcs(x, y)
        if x and y:
            assert near_dup.similar(np.array(x, np.uint64), np.array(y, np.uint64)) == (lcs(x, y) >= 0.8 * (len(x) + len(y) - lcs(x, y)) - 1e-9)


def family(seed, n=150, docs=25, edits=4):
    """Copies of one text with a few words changed: many are similar to some and not to others."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 60)}" for _ in range(n)]
    out = []
    for _ in range(docs):
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(n)] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


def test_classes_equal_brute_force(llm):
    texts = [r[1] for r in data.rows()] + family(1) + family(2, 60, 10, 2) + ["a b c d e f g", "a b c d e f g h"]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = near_dup.classes(docs, "doc_id").collect()
    assert partition((r["id"], r["class"]) for r in got) == partition(enumerate(brute(texts)))
    assert all(r["class_id"] <= r["id"] for r in got)


def test_order_matters():
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in [*range(100, 200), *range(100)])
    x, y = (near_dup.kmers(*near_dup.word_hashes([t]))[0] for t in (a, b))
    assert not near_dup.similar(x, y) and near_dup.similar(x, x)


def test_keep_one(llm):
    docs = data.docs(llm)
    kept = near_dup.keep_one(docs, "doc_id").collect()
    classes = near_dup.classes(docs, "doc_id").collect()
    assert len(kept) == len({r["class"] for r in classes})
    assert near_dup.keep_one(data.empty(llm), "doc_id").count() == 0
    assert near_dup.classes(data.empty(llm).select("doc_id", "text", F.lit(1).alias("id")), "doc_id").count() == 0
