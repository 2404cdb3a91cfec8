"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes (1 to 3 first and last characters), its character 2- and 3-grams, and the word
itself as lexicon entry, hashed into ``CELLS``; every language has a weight per cell, and every ordered pair of
languages a transition weight. Forward-backward gives each word's marginal distribution over languages, in the
context of the whole text; a document's language is the one with the largest mean marginal, its score that mean. So the
score is the language's share of the text. How sure the words' labels are is the certainty: the mean of each word's
largest marginal, whichever language that is.

Training documents are a bounded sample: for each language the ``DOCS_PER_LANG`` different labelled ones (key
and text) with the smallest seeded hash. From each a window of at most ``WORDS_PER_DOC`` words at a hashed place is taken; words bear their
document's language, and windows of different languages are joined end to end so that the model sees
switches. Weights maximise the conditional likelihood by AdaGrad over mini-batches. Prediction reads whole texts.

Words are maximal runs of letters (``str.isalpha``), lower-cased. Cases: null texts and texts without letters are
``und`` with score and certainty 0; without labelled documents everything is ``und``; identical rows are predicted alike;
ties go to the smaller language name; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import payload, unit_hash

CELLS = 1 << 16
DOCS_PER_LANG = 400
WORDS_PER_DOC = 120
EPOCHS = 3
STRIDE = 128
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _TABLES["letters"]


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)


@dataclasses.dataclass
class Words:
    """The words of several texts: cells of whole words and affixes by word, of n-grams by letter; ``CELLS`` is none."""

    by_word: np.ndarray  # words x 7
    by_letter: np.ndarray  # letters x 2: the 2- and the 3-gram that start there
    letter_at: np.ndarray  # each word's first letter
    word_of: np.ndarray  # each letter's word
    text_at: np.ndarray  # each text's first word, and the end

    @property
    def n(self) -> int:
        return len(self.by_word)


def features(texts: list[str]) -> Words:
    """Words and their feature cells, without a loop over words."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[points]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n, size = len(start), stop - start
    ends = np.cumsum([len(t) + 1 for t in lower]) if lower else np.zeros(0, np.int64)
    text_at = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    letter_at = np.cumsum(size) - size
    word_of = np.repeat(np.arange(n), size)
    one = np.append(points[inside], [0, 0, 0]).astype(np.uint64) * np.uint64(0x100000001B3)  # the letters end to end
    two = one[:-1] * np.uint64(31) + one[1:]
    three = two[:-1] * np.uint64(131) + one[2:]
    m = len(word_of)
    right = (letter_at + size)[word_of] - np.arange(m)  # letters from here to the word's end
    by_letter = np.empty((m, 2), np.int32)
    for j, (width, grams) in enumerate(((2, two), (3, three))):
        by_letter[:, j] = np.where(right >= width, _mix(grams[:m], 30 + width), CELLS)
    by_word = np.full((n, 7), CELLS, np.int32)
    if n:  # a polynomial hash of each whole word
        power = np.cumprod(np.full(int(size.max()), np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
        by_word[:, 0] = _mix(np.add.reduceat(one[:m] * power[right - 1], letter_at), 9)
    for width, grams in ((1, one), (2, two), (3, three)):
        some = size >= width
        by_word[some, width] = _mix(grams[letter_at[some]], 10 + width)
        by_word[some, 3 + width] = _mix(grams[(letter_at + size)[some] - width], 20 + width)
    return Words(by_word, by_letter, letter_at, word_of, text_at)


@dataclasses.dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # cells (and a last row of zeros) x languages
    moves: np.ndarray  # from x to

    def emissions(self, words: Words) -> np.ndarray:
        out = np.zeros((words.n, len(self.langs)))
        if words.n:
            for j in range(words.by_word.shape[1]):
                out += self.weights[words.by_word[:, j]]
            grams = self.weights[words.by_letter[:, 0]] + self.weights[words.by_letter[:, 1]]
            out += np.add.reduceat(grams, words.letter_at, axis=0)
        return out

    def gradient(self, words: Words, wrong: np.ndarray) -> np.ndarray:
        cells = np.concatenate([words.by_word.ravel(), words.by_letter.ravel()])
        owner = np.concatenate([np.repeat(np.arange(words.n), words.by_word.shape[1]), np.repeat(words.word_of, 2)])
        grad = np.stack([np.bincount(cells, wrong[owner, c], CELLS + 1) for c in range(len(self.langs))], 1)
        grad[CELLS] = 0
        return grad


def marginals(emissions: np.ndarray, moves: np.ndarray, text_at: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """P(language of word | whole text) by forward-backward, all texts at once."""
    return forward_backward(emissions, moves, text_at, stride)[0]


def forward_backward(emissions: np.ndarray, moves: np.ndarray, text_at: np.ndarray,
                     stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """The words' marginals, and P(language of word | text up to it), of all texts at once.

    Texts are cut into runs of ``stride`` words, which are processed in step; what passes from run to run is first
    found from the runs' transfer matrices (a text's run count in sequence), then each run is gone through.
    """
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k))
    sizes = np.diff(text_at)
    runs = -(-sizes // stride)
    run_text = np.repeat(np.arange(len(sizes)), runs)
    run_no = np.arange(len(run_text)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = text_at[run_text] + run_no * stride
    length = np.minimum(stride, text_at[run_text + 1] - first)
    order = np.argsort(-length, kind="stable")
    first, length, run_text, run_no = first[order], length[order], run_text[order], run_no[order]
    m, steps = len(first), int(length.max())
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # runs longer than t words
    # linear space with a rescaled state: emissions less their largest, transitions as factors
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    a = np.exp(moves - moves.max())
    transfer = np.tile(np.eye(k), (m, 1, 1))
    for t in range(steps):
        c = live[t]
        x = (transfer[:c] @ a) * e[first[:c] + t][:, None, :]
        transfer[:c] = x / x.sum(axis=(1, 2), keepdims=True)
    # states at run borders, run by run of a text: alpha before a run, beta after it
    alpha, beta = np.ones((m, k)), np.ones((m, k))
    place = np.full((len(sizes), int(runs.max()) if m else 0), -1)
    if place.size <= 1 << 24:
        place[run_text, run_no] = np.arange(m)
        at = lambda texts, r: place[texts, r]
    else:
        where = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(run_text, run_no, strict=True))}
        at = lambda texts, r: np.array([where[int(x), r] for x in texts], int)
    by_runs = np.argsort(-runs, kind="stable")
    most = int(runs.max())
    count = [int(np.searchsorted(-runs[by_runs], -r, side="left")) for r in range(most)]
    start = np.ones(k) / k
    for r in range(1, most):
        texts = by_runs[:count[r]]
        before = at(texts, r - 1)
        prior = alpha[before] if r > 1 else np.tile(start, (len(texts), 1))
        x = np.einsum("ij,ijk->ik", prior, transfer[before])
        alpha[at(texts, r)] = x / x.sum(axis=1, keepdims=True)
    alpha[run_no == 0] = start
    for r in range(most - 2, -1, -1):
        texts = by_runs[:count[r + 1]]
        after = at(texts, r + 1)
        x = np.einsum("ijk,ik->ij", transfer[after], beta[after])
        beta[at(texts, r)] = x / x.sum(axis=1, keepdims=True)
    forward = np.empty_like(e)
    state = alpha
    for t in range(steps):
        c = live[t]
        x = (state[:c] @ a) * e[first[:c] + t]
        state[:c] = x / x.sum(axis=1, keepdims=True)
        forward[first[:c] + t] = state[:c]
    out = np.empty_like(e)
    for t in range(steps - 1, -1, -1):
        c = live[t]
        words = first[:c] + t
        x = forward[words] * beta[:c]
        out[words] = x / x.sum(axis=1, keepdims=True)
        x = (e[words] * beta[:c]) @ a.T
        beta[:c] = x / x.sum(axis=1, keepdims=True)
    return out, forward


def fit(samples: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 3) -> Model:
    """A model from (text window, language) pairs by AdaGrad on the conditional log-likelihood."""
    langs = sorted({x for _, x in samples})
    k, random = len(langs), np.random.default_rng(seed)
    model = Model(langs, np.zeros((CELLS + 1, k)), np.zeros((k, k)))
    square_w, square_m = np.full((CELLS + 1, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(samples))
        for i in range(0, len(order), 64):
            some = order[i:i + 64]
            words = features([samples[j][0] for j in some])
            # sequences of two windows each, so that switches occur
            joined = np.append(words.text_at[:-1:2], words.text_at[-1])
            if not words.n:
                continue
            gold = np.repeat([langs.index(samples[j][1]) for j in some], np.diff(words.text_at))
            e = model.emissions(words)
            p, forward = forward_backward(e, model.moves, joined)
            wrong = -p
            wrong[np.arange(words.n), gold] += 1
            grad = model.gradient(words, wrong)
            square_w += grad ** 2
            model.weights += rate * grad / np.sqrt(square_w)
            inner = np.ones(words.n, bool)
            inner[joined[:-1][joined[:-1] < words.n]] = False
            to = np.flatnonzero(inner)
            later = p[to] / np.maximum(forward[to], 1e-300)  # what follows, up to a factor a word
            moved = np.exp(e[to] - e[to].max(axis=1, keepdims=True)) * later
            both = forward[to - 1][:, :, None] * np.exp(model.moves)[None] * moved[:, None, :]
            pairs = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)  # expected moves
            seen = np.bincount(gold[to - 1] * k + gold[to], minlength=k * k).reshape(k, k)
            grad = (seen - pairs) / max(1, len(to))
            square_m += grad ** 2
            model.moves += rate * 0.3 * grad / np.sqrt(square_m)
    model.weights = model.weights.astype(np.float32)
    return model


def _window(text: str, at: int, words: int) -> str:
    """``words`` white-space separated words from a hashed place on."""
    parts = text.split()
    first = at % max(1, len(parts) - words + 1)
    return " ".join(parts[first:first + words])


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC, seed: int = 11) -> Model | None:
    """A model of ``labelled`` (key, text, lang); at most ``docs_per_lang`` windows of a language reach the driver."""
    one = ["lang", "h", "key", "hash"]  # a document; repeated rows of it count once
    rows = (labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
            .withColumn("h", unit_hash(F.col("key"), seed=seed)).withColumn("hash", F.xxhash64("text")))
    once = rows.select(*one).distinct()
    # only hashes that can be among the first are ranked: four times as many as wanted, on average, however large a language
    # is; that fewer than wanted are left has a probability below 1e-100 at the default size
    sizes = once.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    low = F.col("h") <= F.lit(float(1 << 63)) * F.least(F.lit(1.0), F.lit(4.0 * docs_per_lang) / F.col("n"))
    once = once.join(sizes, "lang").where(low).select(*one)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "hash"))
    chosen = once.withColumn("rank", rank).where(F.col("rank") <= docs_per_lang).select(*one)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_window(t, h, words_per_doc) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(1), batch.column(2)], ["text", "lang", "h"])

    sample = rows.join(F.broadcast(chosen), one, "left_semi").dropDuplicates(one).select("text", "lang", "h")
    got = sample.mapInArrow(windows, "text string, lang string, h long").collect()
    got = sorted((r["h"], r["text"], r["lang"]) for r in got)
    return fit([(text, lang) for _, text, lang in got]) if got else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``row`` (the other columns), ``text`` (if it is to be kept), ``lang_pred``, ``score`` and ``certainty`` of every whole text."""
    rows = docs.select(payload(docs, text_col), F.col(f"`{text_col}`").alias("text"))
    if model is None:
        out = rows.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0)).withColumn("certainty", F.lit(0.0))
        return out if keep_text else out.drop("text")
    sent = rows.sparkSession.sparkContext.broadcast(model)  # CELLS x languages weights
    fields = [T.StructField("row", rows.schema["row"].dataType)] + [T.StructField("text", T.StringType())] * keep_text
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("certainty", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: Model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores, sure = [], [], []
            for part in _portions(texts):
                words = features(part)
                p = marginals(crf.emissions(words), crf.moves, words.text_at)
                sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
                tops = np.concatenate([[0.0], np.cumsum(p.max(axis=1))])
                n = np.diff(words.text_at)
                mean = (sums[words.text_at[1:]] - sums[words.text_at[:-1]]) / np.maximum(n, 1)[:, None]
                best = mean.argmax(axis=1)
                langs += [crf.langs[b] if c else "und" for b, c in zip(best, n, strict=True)]
                scores += np.clip(np.where(n > 0, mean.max(axis=1), 0.0), 0, 1).tolist()
                sure += np.clip((tops[words.text_at[1:]] - tops[words.text_at[:-1]]) / np.maximum(n, 1), 0, 1).tolist()
            columns = [batch.column(0)] + [batch.column(1)] * keep_text
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())],
                                             [f.name for f in schema.fields])

    return rows.mapInArrow(label, schema)


def _portions(texts: list[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters; a longer text is alone."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def held_out(key: Column) -> Column:
    """True for documents that training never sees."""
    return F.crc32(key.cast("string")) % 5 == 0
