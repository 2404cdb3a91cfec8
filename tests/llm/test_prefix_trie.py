import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pulse.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, digest string, b int"


def rebuilt(rows):
    """Plain Python: the turn lists of the contract."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (r, t)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        origin = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(origin, [])[:h] + turns[h:])
    return out


def plain(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if paths[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows):
    turns = pt.turns_of(spark.createDataFrame(rows, SCHEMA).repartition(3), "conv_id", "turn", "role", "text")
    nodes, ends = pt.trie(*pt.with_shared_heads(turns, 20, 3, F.crc32(F.col("conv").cast("string")) % 4))
    sha = pt.listed_sha(ends.select("owner", "depth", "conv"), ["owner", "depth"], "conv")
    out = nodes.join(sha, ["owner", "depth"], "left").select(
        "owner", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def row(c, turn, role, text):
    return c, turn, role, text, "clash", 1, "clash", 2


def awkward():
    rows = [row(20, 0, "user", "hi there"), row(21, 0, "user", "hi there"), row(21, 1, None, None), row(22, None, "user", "null turn first"),
            row(22, 0, "user", "hi there"), row(None, 0, "user", "no id"), row(41, 5, "user", "origin absent"), row(41, 7, "user", "more"),
            row(-7, 0, "user", "negative"), row(0, 0, "user", "x"), row(3, 1, "user", "tie"), row(3, 1, "assistant", "tie"),
            row(3, 2, "user", "repeated"), row(3, 2, "user", "repeated"), row(5, 0, "ab", "c"), row(6, 0, "a", "bc"), row(7, 0, "user", " \t\n")]
    return rows + [row(99, i, "user", "word " * 40000) for i in range(2)]


def conversations(seed, n=120, kinds=3, longest=14):
    r = random.Random(seed)
    return [row(c, t, r.choice(["user", "assistant"]) if r.random() < .2 else "user", f"turn {r.randrange(kinds)}" if r.random() < .9 else "a b c")
            for c in range(n) for t in range(r.randrange(1, longest))]


@pytest.mark.parametrize("rows", [awkward(), conversations(1), conversations(2, kinds=1), conversations(3, n=60, kinds=1, longest=30)])
def test_tree_equals_brute_force(llm, rows):
    assert found(llm, rows) == plain(rebuilt(rows))


def test_long_chains_cross_runs_and_copies_share_blocks(llm, monkeypatch):
    monkeypatch.setattr(pt, "RUN_BITS", 2)  # runs of four rows
    rows = [row(c, t, "user", f"step {t}" if t < 90 - 7 * (c % 3) else f"end {c % 2}") for c in (1, 2, 21, 22, 41, 61) for t in range(100)]
    assert found(llm, rows) == plain(rebuilt(rows))


def test_only_diverging_blocks_are_refined(llm):
    """Equal conversations are one kind of block a boundary: the table that is refined stays empty."""
    rows = [row(20 * c, t, "user", f"t{t}") for c in range(50) for t in range(9)]
    turns = pt.turns_of(llm.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    blocks = pt._blocks(turns.select("conv", F.shiftright("pos", 2).alias("b"), *[F.xxhash64(F.lit(i), "pos", "digest").alias(f"x{i}") for i in (1, 2)]))
    assert blocks.count() == 150 and blocks.select(*pt.KIND).distinct().count() == 3


def test_one_conversation_with_most_turns(llm):
    rows = [row(5, t, "user", f"w{t % 7} x") for t in range(3000)] + conversations(4, n=40)[:100]
    assert found(llm, rows) == plain(rebuilt(rows))


def test_empty(llm):
    assert found(llm, []) == [] and found(llm, [row(None, 0, "a", "b")]) == []
