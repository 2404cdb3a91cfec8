import itertools

import numpy as np
from pyspark.sql import functions as F

from pulse.llm import langid
from pulse.llm.queries import op8_lang_crf

from . import data


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    for stride in (1, 2, 3, 128):
        for _ in range(10):
            k, sizes = 3, r.integers(0, 7, 5)
            at = np.concatenate([[0], np.cumsum(sizes)])
            e, moves = r.normal(size=(at[-1], k)), r.normal(size=(k, k))
            got = langid.marginals(e, moves, at, stride)
            for x, y in zip(at, at[1:]):
                total = np.zeros((y - x, k))
                for s in itertools.product(range(k), repeat=int(y - x)):
                    if s:
                        score = sum(e[x + i, s[i]] for i in range(len(s))) + sum(moves[s[i], s[i + 1]] for i in range(len(s) - 1))
                        weight = np.exp(score) * np.exp(moves[:, s[0]]).sum()  # any language may come before a text
                        for i, c in enumerate(s):
                            total[i, c] += weight
                if y > x:
                    assert np.allclose(total / total.sum(1, keepdims=True), got[x:y])


def test_held_out_accuracy(llm):
    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in llm.read.parquet(f"{d}/documents.parquet").collect()}
    got = op8_lang_crf(llm, d).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_code_switched_words_are_told_apart():
    model = langid.fit([("the of and with this from that " * 8, "en")] * 20 + [("der und nicht ist mit von ein " * 8, "de")] * 20)
    words = langid.features(["the of and with this from nicht ist mit von ein der und"])
    p = langid.marginals(model.emissions(words), model.moves, words.text_at)
    assert [model.langs[i] for i in p.argmax(1)] == ["en"] * 6 + ["de"] * 7


def test_cases(llm):
    docs = data.docs(llm)
    model = langid.train(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(data.rows())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and (letters or r["score"] == 0)
    assert langid.train(data.empty(llm).select(F.col("doc_id").alias("key"), "text", "lang")) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(data.empty(llm), model).count() == 0


def test_repeated_rows_are_one_training_document(llm, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "fit", taken.extend)
    rows = [(i, f"text number {'x' * i} of {lang}", lang) for i in range(8) for lang in ("en", "de")] * 40
    langid.train(llm.createDataFrame(rows, "key long, text string, lang string").repartition(3), docs_per_lang=5)
    assert len(taken) == len(set(taken)) == 10
    assert sorted(lang for _, lang in taken) == ["de"] * 5 + ["en"] * 5
