import zlib

import corpus_pipeline as cp
import pytest

from pulse.llm.common import cut, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and with this from that", "de": "der und nicht ist mit von ein", "fr": "les des une dans pour avec cette"}


def test_stages(llm):
    d = "/root/testdata/sf0.001"
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "tokens"]
    docs = cut(table(llm, d, "documents").select(*cp.COLUMNS))
    kinds, before, texts = docs.dtypes, docs.count(), {}
    texts["in"] = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(cp.STAGES):
        docs = cut(stage(llm, docs, d))
        if i + 1 < len(cp.STAGES):
            assert docs.dtypes == kinds
            texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {k for k, t in texts["in"].items() if any(c.isalpha() for c in t or "")}
    assert len(texts["language_id"]) >= 0.98 * len(clean)  # documents in a language stay
    assert set(texts["language_id"]) <= clean and before == len(texts["in"])
    assert set(texts["line_dedup"]) == set(texts["language_id"])
    assert set(texts["near_dedup"]) <= set(texts["line_dedup"]) and set(texts["mixing"]) <= set(texts["near_dedup"])
    ids = [r for r in docs.collect()]
    assert {r["doc_id"] for r in ids} == set(texts["mixing"]) and all(r["n_tokens"] == len(r["ids"]) for r in ids)


def test_whole_run(llm):
    assert cp.run(llm, "/root/testdata/sf0.001").columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_documents_in_several_languages_stay(llm):
    rows = [(3 * i + j, (w + " ") * 8, lang, "a", 1) for i in range(30) for j, (lang, w) in enumerate(WORDS.items())]
    several = " ".join((w + " ") * 3 for w in WORDS.values())
    rows += [(1000, several, None, "a", 1), (1001, "123 ?!", None, "a", 1), (1002, None, None, "a", 1)]
    got = {r["doc_id"]: r["text"] for r in cp.language_id(llm, llm.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {r[0]: r[1] for r in rows if r[0] <= 1000}


@pytest.mark.parametrize("lang", [None, "en"])
def test_without_a_model_all_documents_stay(llm, lang):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]  # never trained on
    rows = [(i, f"some text {i}" if i % 2 else None, lang, "a", 1) for i in held]
    got = cp.language_id(llm, llm.createDataFrame(rows, SCHEMA), "")
    assert sorted(tuple(r) for r in got.collect()) == rows and got.columns == list(cp.COLUMNS)
