"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, t string, class string"


def texts() -> list:
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "über", "naïve", "x1", "the", "of", "and", "Zeit", "año"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = "\n".join(line(9) for _ in range(8))
    out = [None, "", " \t\n", "\n\n", "?!", "one", "a b c d", base, base, base.replace("alpha", "omega", 1), base.upper(),
           "<|endoftext|> in text <|endoftext|>", "x" * 3000, "ab" * 500 + "é" * 300 + "  \n " * 50, line(4000)]
    for i in range(30):
        out.append("\n".join(["Shared  LINE ", line(12), "shared  line" if i % 2 else "\tshared  line", line(5)]))
    return out


def rows() -> list:
    sources = ["a", "b", None, "c", "a"]
    found = [(i, t, "en" if i % 3 else None, sources[i % 5], None if t is None else len(t), "r", 1, "t", "c")
             for i, t in enumerate(texts())]
    return [*found, found[7], found[7], (None, "null id text here now", "en", "a", 5, None, None, None, None), (7, "same id, other text", "en", "b", 3, "", 0, "", "")]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
