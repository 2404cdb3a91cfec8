import math
import re
from collections import Counter

import pytest

from pulse.llm import lexical

from .data import docs as table
from .data import empty, rows, texts

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    tallies = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in tallies]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in tallies for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), n in zip(tallies, sizes, strict=True):
            score = 0
            for t in set(plain_terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + (50 * n * n_docs) // total
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha Beta gamma, über x1"), (2, "the-of&and Zeit año"), (3, None), (4, ""), (5, "?!"), (6, "absent words only zzz"),
         (7, "alpha " * 500), (1, "delta SHARED line"), (None, "one a b c d"), (8, "é" * 300 + " ab")]


def ranked(spark, docs, items, k, **limits):
    asked = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, number int")
    return sorted((tuple(r) for r in lexical.rank(docs, asked, k, **limits).collect()), key=repr)


@pytest.mark.parametrize("k,limits", [(5, {}), (50, {}), (3, {"tile_bytes": 60}), (50, {"exact": 1 << 34})])
def test_ranks_equal_brute_force(llm, k, limits):
    docs = table(llm)
    want = plain([(r[0], r[1]) for r in rows()], ITEMS, k)
    assert ranked(llm, docs, ITEMS, k, **limits) == want


def test_vocabulary_tiles_are_cut_where_sums_could_pass_the_bound():
    import numpy as np
    weights = np.array([900, 0, 800, 700, 600])
    group = lexical.Group([(0, np.array([0, 1, 2])), (1, np.array([2, 3, 4]))], weights, exact=1_600 * lexical.IMPACT)
    assert group.cuts == [0, 1, 3, 4]
    row, at, impact = np.array([0, 0, 0, 1]), np.array([0, 2, 3, 4]), np.array([5, 7, 11, 13])
    assert group.scores(2, row, at, impact).tolist() == [[900 * 5 + 800 * 7, 800 * 7 + 700 * 11], [0, 600 * 13]]


def test_ties_go_to_the_smaller_id_whatever_the_block(llm):
    docs = llm.createDataFrame([(i, "same words here") for i in range(1500, 0, -1)] + [(0, "other")] * 300, "doc_id long, text string").repartition(7)
    got = ranked(llm, docs, [(1, "words")], 50)
    assert sorted(r[2] for r in got) == list(range(1, 51)) and len({r[3] for r in got}) == 1


def test_terms_of_long_texts_are_the_pattern():
    for t in [*texts(), "".join(map(chr, range(1, 0x250))) * 20, "word, Ünïcode x y " * 100_000]:
        assert [x.decode() for some in lexical.terms(t or "") for x in some] == plain_terms(t)


def test_empty(llm):
    assert ranked(llm, empty(llm), ITEMS, 5) == []
    assert ranked(llm, table(llm), [], 5) == []
    assert ranked(llm, table(llm), [(1, None)], 5) == []
