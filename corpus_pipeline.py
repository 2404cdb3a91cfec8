"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, tokenizing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.

* language_id: a model learned from the labelled documents predicts every text; documents without letters (und)
  and those whose words are labelled with a mean certainty below ``LEAST_SCORE`` go. Every learned language stays, also
  several in one text. Without a model (no labelled document, or all of them held out) nothing is judged and all stay.
* line_dedup: lines whose key occurs in 10 documents or more lose all their copies; n_chars follows. A text
  with 10 or more exact copies so loses every line in each of them.
* near_dedup: one document of each class of near-duplicates stays, the one with the smallest id.
* mixing: sources by weights 5, 2, 1; documents are taken once, twice or not at all, a row for each time.
* tokens: the ids of every whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm import bpe, langid, lines, mixing, near_dup
from pulse.llm.common import cut, ready, table
from pulse.llm.queries import BYTE_BPE, lang_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.4


def _documents(df: DataFrame, text_changed: bool = False) -> DataFrame:
    """``row`` and ``text`` as the columns of documents."""
    out = df.select(*[F.col("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in COLUMNS])
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if text_changed else out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    model = lang_model(docs)
    if model is None:
        return docs.select(*COLUMNS)
    done = langid.predict(docs.select(*COLUMNS), model)
    return _documents(done.where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return _documents(lines.drop_frequent_lines(docs.select(*COLUMNS)), text_changed=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return _documents(near_dup.keep_one(docs.select(*COLUMNS), "doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix(rows, mixing.words(F.col("text")), ["doc_id", "text_hash"])
    times = mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("time"))
    return times.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), BYTE_BPE)
    return done.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("tokens", tokens)]
#: Language prediction and alignment cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
