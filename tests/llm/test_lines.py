from collections import Counter

import numpy as np
import pytest

from pulse.llm import lines

from . import data

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, min_docs):
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for parts in split for k in {key(x) for x in parts})
    gone = {k for k, n in seen.items() if n >= min_docs and k}
    return [("\n".join(x for x in p if key(x) not in gone), len(p), sum(key(x) in gone for x in p)) for p in split]


@pytest.mark.parametrize("index_mb", [64, 0])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_equals_brute_force(llm, index_mb, min_docs):
    got = [(r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_frequent_lines(data.docs(llm), min_docs=min_docs, index_mb=index_mb).collect()]
    assert sorted(got) == sorted(brute([r[1] for r in data.rows()], min_docs))


def test_hash_is_minimal_and_perfect():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 4096):
        a, b = r.integers(0, 1 << 63, n, dtype=np.uint64), r.integers(0, 1 << 63, n, dtype=np.uint64)
        displace, prints, counts = lines.build_shard(a, b, np.arange(1, n + 1))
        assert sorted(counts) == list(range(1, n + 1))  # every slot is used once
        probe = lines.Probe([{"shard": 0, "n": n, "displace": displace.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes()}], 1)
        assert (probe.counts(np.stack([a, b], 1)) == np.arange(1, n + 1)).all()
        assert (probe.counts(np.stack([a, b + np.uint64(1)], 1)) == 0).all()


def test_empty_table(llm):
    assert lines.drop_frequent_lines(data.empty(llm)).count() == 0
