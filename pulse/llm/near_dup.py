"""Near-duplicate classes by Order MinHash.

A text is its sequence of lower-cased words; its k-mers are runs of ``WORDS`` words, labelled with their occurrence
number (the third equal k-mer differs from the first). One sample of Order MinHash takes the ``KEEP`` k-mers with
the smallest seeded hashes and keeps them in the order of the text, so it responds to edits and moves, not only to
shared k-mers. ``ROWS`` samples make a band; texts that agree in one of ``BANDS`` bands are candidates.

Candidates are verified by banded alignment: the longest common subsequence of both k-mer sequences (bit-parallel,
inside the diagonal band that a pass allows), as share of the k-mers of either side: matched / (m + n - matched).
A link needs ``SIMILARITY``.

K-mers that one candidate alone holds limit what it can have in common with any other; texts and pairs that
cannot reach the similarity by this exact bound are not tested. After the first round texts also know their
differences to a hub; two texts that differ from the same hub in too many places are not tested either.

Texts with equal words are one node from the start. A bucket's members are not paired with each other: they are
tested against its hubs (1, then 8, 64, ... members: first those with the fewest k-mers of their own, such as the
text that the others are copies of, then in a hashed order), and only across classes that are
not yet connected, until every bucket lies in one class or all its members have been hubs. So no link that would
join two classes is lost, and a bucket whose members belong together costs one test each. Links become
classes by distributed label propagation with shortcuts.

Cases: null text is empty; texts without words are equal; texts of fewer than ``WORDS`` words have one k-mer, all
their words; identical rows are in one class; null ids belong to a class but never name it (unless it has no
other); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import cut, payload

WORDS, KEEP, ROWS, BANDS, SIMILARITY = 5, 2, 2, 20, 0.8
_POS_BITS = np.uint64(24)
_NONE = np.uint64((1 << 64) - 1)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0x94D049BB133111EB)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and the number of words of each text."""
    digest = xxhash.xxh3_64_intdigest
    lists = [t.lower().split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((digest(w) for x in lists for w in x), np.uint64, int(sizes.sum()))
    return flat, sizes


def kmers(flat: np.ndarray, sizes: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of every text end to end, and their numbers."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = np.zeros(len(flat), np.uint64)
    for i in range(words):
        shifted = np.concatenate([flat[i:], np.zeros(min(i, len(flat)), np.uint64)])
        grams += np.where(place + i < sizes[text], shifted, np.uint64(i + 1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & ((1 << 64) - 1))
        grams ^= grams >> np.uint64(29)
    starts = place <= np.maximum(sizes[text] - words, 0)
    return grams[starts], np.where(sizes > 0, np.maximum(sizes - words + 1, 1), 0)


def occurrences(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """K-mer hashes that also tell how many equal ones came before in the text."""
    if not len(grams):
        return grams
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = grams ^ _mix(text + np.uint64(1), 77)
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    run = np.arange(len(key)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    nth = np.empty(len(key), np.uint64)
    nth[order] = run.astype(np.uint64)
    return grams + nth * np.uint64(0xD6E8FEB86659FD93)


def sketches(grams: np.ndarray, counts: np.ndarray, rows: int = ROWS, bands: int = BANDS, keep: int = KEEP) -> np.ndarray:
    """(texts with k-mers, bands): one hash for each band of Order MinHash samples."""
    some = counts > 0
    n = counts[some]
    out = np.zeros((len(n), bands), np.uint64)
    if not len(n):
        return out.view(np.int64)
    at = np.cumsum(n) - n
    place = (np.arange(len(grams)) - np.repeat(at, n)).astype(np.uint64)
    for sample in range(rows * bands):
        hashed = (_mix(grams, sample + 1) >> _POS_BITS << _POS_BITS) | (place & np.uint64((1 << 24) - 1))
        picked = []
        for i in range(keep):
            least = np.minimum.reduceat(hashed, at)
            picked.append(least)
            if i + 1 < keep:
                hashed[hashed == np.repeat(least, n)] = _NONE
        picked = np.stack(picked, 1)
        order = np.argsort(np.where(picked == _NONE, _NONE, picked & np.uint64((1 << 24) - 1)), axis=1, kind="stable")
        in_text = np.take_along_axis(picked >> _POS_BITS, order, 1)
        value = np.zeros(len(n), np.uint64)
        for i in range(keep):
            value = _mix(value + in_text[:, i], i + 3)
        band = sample // rows
        out[:, band] = _mix(out[:, band] + value, band + 5)
    return out.view(np.int64)


def common_in_order(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence that stays within ``band`` of the diagonal (bit-parallel)."""
    head = 0
    while head < len(x) and head < len(y) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < len(x) - head and tail < len(y) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[head:len(x) - tail], y[head:len(y) - tail]
    if not x or not y:
        return head + tail
    done, low, block = 0, 0, max(64, band)
    for first in range(0, len(x), block):  # columns first - band .. first + block + band, as bits from ``start`` on
        start, stop = max(0, first - band), min(len(y), first + block + band)
        if first == 0:
            state, width = (1 << stop) - 1, stop
        else:
            gone = start - low
            done += gone - (state & ((1 << gone) - 1)).bit_count()
            state >>= gone
            more = stop - (low + width)
            state |= ((1 << max(0, more)) - 1) << (width - gone)
            width = stop - start
        low = start
        if width <= 0:
            break
        mask, full = {}, (1 << width) - 1
        for j, v in enumerate(y[start:stop]):
            mask[v] = mask.get(v, 0) | 1 << j
        for v in x[first:first + block]:
            m = mask.get(v)
            if m:
                u = state & m
                state = ((state + u) | (state & ~m)) & full
    return head + tail + done + (width - state.bit_count() if width > 0 else 0)


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two k-mer sequences agree in order to ``least``."""
    m, n = len(x), len(y)
    if not m or not n:
        return m == n
    need = least / (1 + least) * (m + n)  # common k-mers that a pass takes
    if min(m, n) < need:
        return False
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    both, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    shared = int(np.minimum(cx[ix], cy[iy]).sum())
    if shared < need - 1e-9:  # not even in any order
        return False
    band = int(m + n - 2 * need) + 1  # more steps off the diagonal leave too few common ones
    matched = common_in_order(x.tolist(), y.tolist(), band)
    return matched >= least * (m + n - matched) - 1e-9


def _portions(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, name, n, bands): per row a digest of the text, one of its words, its k-mers and its bands."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _portions(batch.column(2).to_pylist()):
                flat, sizes = word_hashes(texts)
                grams, counts = kmers(flat, sizes)
                found = sketches(occurrences(grams, counts), counts)
                bands = np.split(found.ravel(), np.cumsum(np.where(counts > 0, BANDS, 0))[:-1])
                ends = np.cumsum(sizes)
                names = [xxhash.xxh3_128_digest(flat[e - s:e].tobytes()) for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(names, pa.binary()),
                     pa.array(counts), pa.array([b.tolist() for b in bands], pa.list_(pa.int64()))], ["id", "t", "name", "n", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.unhex(F.md5("text")).alias("t"), "text").mapInArrow(
        sketch, f"id {kind}, t binary, name binary, n long, bands array<long>")


def shared_kmers(texts: DataFrame) -> DataFrame:
    """(t, c): how many k-mers (with their occurrence numbers) of each text (t, text) another text holds as well."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _portions(batch.column(1).to_pylist()):
                grams, counts = kmers(*word_hashes(some))
                whose = np.frombuffer(b"".join(t[:8] for t in batch.column(0).slice(at, len(some)).to_pylist()), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(occurrences(grams, counts).view(np.int64)), pa.array(np.repeat(whose, counts))], ["g", "d"])

    # texts are named by half their digest here: should two meet, their numbers add up, and a bound stays a bound
    grams = texts.select("t", "text").mapInArrow(spread, "g long, d long")
    common = grams.groupBy("g").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1).select("g")
    counted = cut(grams.join(common, "g", "left_semi").groupBy("d").agg(F.count(F.lit(1)).alias("c")))
    first = F.conv(F.hex(F.substring("t", 1, 8)), 16, -10).cast("long")
    return texts.select("t", first.alias("d")).join(counted, "d").select("t", "c")


TESTED = "x binary, y binary, linked boolean, hub binary, member binary, of int, lacks array<long>, adds array<long>"


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``pairs`` (x, y, tx, ty, hub: names, text digests, which of both is the hub) tested over ``texts`` (t, text).

    ``linked`` if they align. ``of`` k-mers that the hub has, the other one lacks some and adds others; both lists
    are null if they are long.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def grams(t: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if t not in known:
                if len(known) >= 64:
                    known.clear()
                found, counts = kmers(*word_hashes([text]))
                known[t] = found, occurrences(found, counts)
            return known[t]

        for batch in batches:
            rows: list[tuple] = []
            for x, y, tx, ty, hub, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (a, named_a), (b, named_b) = grams(tx, one), grams(ty, two)
                base, other = (named_a, named_b) if hub == x else (named_b, named_a)
                lacks, adds = np.setdiff1d(base, other), np.setdiff1d(other, base)
                few = len(lacks) + len(adds) <= len(base) // 2
                rows.append((x, y, similar(a, b, least), hub, y if hub == x else x, len(base),
                             lacks.view(np.int64) if few else None, adds.view(np.int64) if few else None))
            kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["x", "y", "linked", "hub", "member", "of", "lacks", "adds"]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    first = pairs.join(texts.select(F.col("t").alias("tx"), F.col("text").alias("one")), "tx")
    both = first.join(texts.select(F.col("t").alias("ty"), F.col("text").alias("two")), "ty")
    return both.select("x", "y", "tx", "ty", "hub", "one", "two").mapInArrow(align, TESTED)


def differences(tested: DataFrame) -> DataFrame:
    """(name, ref, of, lacks, adds): each tested text against the hub that most texts were tested against.

    What two texts have in common follows from their differences to one hub, without the texts.
    """
    popular = tested.groupBy("hub").agg(F.count(F.lit(1)).alias("tests"), F.first("of").alias("of"))
    none = F.array().cast("array<long>")
    rows = (tested.where(F.col("lacks").isNotNull()).select("hub", F.col("member").alias("name"), "lacks", "adds")
            .join(popular, "hub").select("name", F.struct("tests", F.col("hub").alias("ref"), "of", "lacks", "adds").alias("d"))
            .unionAll(popular.select(F.col("hub").alias("name"), F.struct(
                "tests", F.col("hub").alias("ref"), "of", none.alias("lacks"), none.alias("adds")).alias("d"))))
    return rows.groupBy("name").agg(F.max("d").alias("d")).select("name", "d.ref", "d.of", "d.lacks", "d.adds")


def connected(links: DataFrame, parts: int) -> DataFrame:
    """(v, label): the smallest name that each end of ``links`` (x, y) is connected with."""
    ways = cut(links.unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), parts)
    labels = cut(ways.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("v"), F.least("x", "y").alias("label")), parts)
    while True:
        near = (ways.join(labels.select(F.col("v").alias("x"), "label"), "x").groupBy(F.col("y").alias("v"))
                .agg(F.min("label").alias("near")))
        seen = cut(labels.join(near, "v").select("v", "label", F.least("label", "near").alias("now")), parts)
        # a shortcut: what a label's own vertex has found holds for all that bear it
        further = seen.select(F.col("v").alias("now"), F.col("now").alias("further"))
        after = cut(seen.join(further, "now").select("v", F.col("further").alias("now"), (F.col("further") != F.col("label")).alias("moved")), parts)
        labels = after.select("v", F.col("now").alias("label"))
        if not after.where("moved").limit(1).count():
            return labels


def classes(docs: DataFrame, id_col: str, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, t, class, class_id): per row of docs its text's digest, its class and the class's smallest id."""
    rows = cut(sketched(docs, id_col, text_col))
    nodes = cut(rows.groupBy("name").agg(F.min("t").alias("t"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    listed = nodes.select("name", "t", "n", F.posexplode("bands").alias("band", "h")).select(
        "name", "t", "n", F.xxhash64("band", "h").alias("bucket"))
    crowded = listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = cut(listed.join(crowded, "bucket").drop("size"))
    source = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("t", F.unhex(F.md5("text")))
    texts = cut(source.join(members.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text")))
    # a link needs this share of either side's k-mers: what only one text holds rules partners out, without a test
    members = (members.join(shared_kmers(texts), "t", "left").withColumn("c", F.coalesce("c", F.lit(0)))
               .where((F.col("c") >= F.col("n") * F.lit(least) - 1e-9) | (F.col("n") == 0)))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = cut(members.join(crowded, "bucket").withColumn("turn", F.xxhash64("name")))
    parts = max(8, members.count() // 100_000)  # rows a file of what is kept between rounds
    labels = cut(members.select("name").distinct().select("name", F.col("name").alias("class")), parts)
    tested = refs = None
    low, high = 0, 1
    while True:
        now = members.where(F.col("size") - 1 > low).join(labels, "name")
        if tested is not None:  # in the first round every member is a class of its own
            mixed = now.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b")).where(F.col("a") != F.col("b"))
            now = now.join(mixed.select("bucket"), "bucket", "left_semi")
        if refs is None:
            unknown = {"ref": "binary", "of": "int", "lacks": "array<long>", "adds": "array<long>"}
            now = now.select("*", *[F.lit(None).cast(k).alias(c) for c, k in unknown.items()])
        else:
            now = now.join(refs, "name", "left")
        now = cut(now, parts)
        if not now.limit(1).count():
            break
        turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("n") - F.col("c"), "turn", "name"))
        hubs = now.withColumn("rank", turn).where(F.col("rank") <= high).where(F.col("rank") > low)
        hubs = hubs.select("bucket", *[F.col(c).alias(f"hub_{c}") for c in ("name", "t", "n", "c", "class", "ref", "lacks", "adds")])
        need = F.lit(least / (1 + least)) * (F.col("n") + F.col("hub_n")) - 1e-9  # k-mers in common
        common = (F.col("of") - F.size(F.array_union("lacks", "hub_lacks")) + F.size(F.array_intersect("adds", "hub_adds")))
        may = (F.least("n", "hub_n", "c", "hub_c") >= need) & F.when(F.col("ref") == F.col("hub_ref"), common >= need).otherwise(True)
        swap = F.col("hub_name") < F.col("name")
        ends = {"x": ("hub_name", "name"), "y": ("name", "hub_name"), "tx": ("hub_t", "t"), "ty": ("t", "hub_t")}
        pairs = (now.join(hubs, "bucket").where((F.col("class") != F.col("hub_class")) & may)
                 .select(*[F.when(swap, F.col(a)).otherwise(F.col(b)).alias(c) for c, (a, b) in ends.items()], F.col("hub_name").alias("hub"))
                 .groupBy("x", "y").agg(F.first("tx").alias("tx"), F.first("ty").alias("ty"), F.min("hub").alias("hub")))
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = cut(pairs, parts)
        results = cut(verified(pairs, texts, least), 4 * parts)
        links = results.where("linked").select("x", "y")
        if refs is None:
            refs = cut(differences(results), parts)
        tested = pairs.select("x", "y") if tested is None else tested.unionAll(pairs.select("x", "y"))
        named = labels.select(F.col("name").alias("x"), F.col("class").alias("cx"))
        ends = (links.join(named, "x").join(named.select(F.col("x").alias("y"), F.col("cx").alias("cy")), "y")
                .select(F.col("cx").alias("x"), F.col("cy").alias("y")))
        joined = connected(ends, parts).select(F.col("v").alias("class"), "label")
        labels = cut(labels.join(joined, "class", "left").select("name", F.coalesce("label", "class").alias("class")), parts)
        low, high = high, 8 * high
    named = rows.join(labels, "name", "left").select("id", "t", F.coalesce("class", "name").alias("class"))
    least_id = named.groupBy("class").agg(F.min("id").alias("class_id"))
    return named.join(least_id, "class").select("id", "t", "class", "class_id")


def keep_one(docs: DataFrame, id_col: str, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest id (then text digest), as ``row`` and ``text``."""
    found = cut(classes(docs, id_col, text_col, least))
    first = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first"))
    winners = (found.join(first, "class").where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t")))
               .groupBy("id", "t").agg(F.count(F.lit(1)).alias("times")))
    rows = docs.select(payload(docs, text_col), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("key"))
    same = rows["id"].eqNullSafe(winners["id"]) & (rows["key"] == winners["t"])
    stay = rows.join(winners, same).select("row", "text", rows["id"].alias("id"), "key", "times")
    once = stay.where(F.col("times") == 1).select("row", "text")
    repeated = stay.where(F.col("times") > 1).dropDuplicates(["id", "key"]).select("row", "text")  # equal rows: any of them
    return once.unionAll(repeated)
