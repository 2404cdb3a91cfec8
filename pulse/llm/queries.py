"""The registered queries of this subpackage: each applies one operator to its whole table.

The operators keep their own results (ids, texts, spans); the queries derive digests from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.ranking import numbered
from pulse.llm import (ann, bpe, langid, lexical, lines, metric_join, mixing, near_dup, prefix_trie, secret_scan,
                       sharding, topk, urls, vectors)
from pulse.llm.common import cut, table

BYTE_BPE = "byte_bpe_50k.json"


def _sha(text) -> Column:
    return F.sha2(text, 256)


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, BYTE_BPE)
    return done.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                       _sha(F.col("decoded")).alias("decoded_sha256"))


def op2_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.words(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash")))
    mixed = mixing.mix(docs, F.col("words"), ["doc_id", "text_hash"])
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("row.source").alias("source"))


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op3_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    done = urls.judge(pages, URL_RULES)
    return done.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op4_line_mph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lines.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", _sha(F.col("text")).alias("kept_sha256"))


def op6_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{secret_scan.KINDS[i]}")  # noqa: B023
              for i in range(3)]
    return done.select(F.col("row.doc_id").alias("doc_id"), *counts,
                       _sha(secret_scan.listed(F.col("base"))).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents")
    # a language's place among all that occur, in code point order and equally spaced; null has none
    places = numbered(docs.select("lang").where(F.col("lang").isNotNull()).distinct(), [F.col("lang").asc()], out="place")
    docs = docs.join(places, "lang", "left").select(
        "doc_id", "place", F.octet_length(text).cast("long").alias("n_bytes"), F.length(text).cast("long").alias("n_points"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    dims = {"lang": F.col("place"), "bytes": F.log2(F.col("n_bytes") + 16),
            "wide": (F.col("n_bytes") - F.col("n_points")) / F.greatest(F.col("n_points"), F.lit(1))}
    done = sharding.kd_shards(docs, F.col("n_bytes") + 16, dims, F.col("text_hash"), [F.col("doc_id")], shards=40)
    return done.select(F.col("row.doc_id").alias("doc_id"), "size", F.col("row.text_crc32").alias("text_crc32"),
                       F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Usable vectors as (id, vector), and the most components that one has."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = rows.where(vectors.usable(F.col("vector")))
    return rows, rows.agg(F.max(F.size("vector"))).first()[0] or 1


def op5_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dims = _embeddings(spark, sf_dir)
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return topk.top_k(rows.select("id", whole.alias("vector")), F.col("id") % 50 == 0, k=5, dims=dims)


def lang_model(docs: DataFrame) -> langid.Model | None:
    """The language model of all labelled documents that are not held out."""
    rest = docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(True)))
    return langid.train(rest.select(F.col("doc_id").alias("key"), "text", "lang"))


def op8_lang_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = langid.predict(docs.select("doc_id", "text"), lang_model(docs), keep_text=False)
    doc_id = F.col("row.doc_id")
    return done.select(doc_id.alias("doc_id"), langid.held_out(doc_id).alias("held_out"), "lang_pred", "score")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.classes(docs, "doc_id").select(F.col("id").alias("doc_id"), "class_id")


def op10_ann_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dims = _embeddings(spark, sf_dir)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    return ann.search(rows, F.col("id") % 100 == 0, k=10, dims=dims, tables=8, probes=16)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    taken = F.crc32(F.col("conv").cast("string")) % 4
    nodes, ends = prefix_trie.trie(*prefix_trie.with_shared_heads(turns, 20, 3, taken))
    found = nodes.join(prefix_trie.listed_sha(ends.select("owner", "depth", "conv"), ["owner", "depth"], "conv"), ["owner", "depth"], "left")
    return found.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", _sha(F.lit(""))).alias("ends_sha256"))


def op12_lexical_blas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = metric_join.components(rows, least=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_bpe_tree, op2_mix_budget, op3_url_lm_ratio, op4_line_mph, op5_topk_nra,
                               op6_secret_markov, op7_kd_shards, op8_lang_crf, op9_order_minhash,
                               op10_ann_cross_polytope, op11_prefix_trie, op12_lexical_blas, op13_metric_join)}

#: DuckDB statements for what SQL can state.
ORACLES: dict[str, str] = {
    "op4_line_mph": r"""
WITH split AS (
  SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS place FROM split
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc
""",
    "op5_topk_nra": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    # crc32 bit by bit over the decimal digits of the id
    "op11_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, y: list_reduce(list_concat([xor(a, y)], range(8)),
      lambda v, i: xor(v >> 1, if(v & 1 = 1, 3988292384, 0)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN turns ON turns.c = convs.c - convs.c % 20 AND pos < h
  UNION ALL SELECT c, 1, pos, role, text FROM turns JOIN convs USING (c) WHERE pos >= h
), paths AS (
  SELECT c, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
), steps AS (
  SELECT c, path, unnest(range(len(path) + 1)) AS depth FROM paths
), nodes AS (
  SELECT path[1:depth] AS prefix, depth, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(path) = depth), '') AS ends
  FROM steps GROUP BY ALL
), valued AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.prefix[1:n.depth] = n.prefix) AS n_children,
         (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS saves
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:p.depth]
), subtrees AS (
  SELECT up, prefix[1:up] AS prefix, count_if(n_children = 0) AS n_leaves, sum(saves)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM valued) GROUP BY ALL
)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN subtrees s ON s.up = v.depth AND s.prefix = v.prefix
""",
    "op12_lexical_blas": r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (
  SELECT doc, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), corpus AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM sized
), items AS (
  SELECT item, item_id, unnest(list_distinct(terms)) AS term
  FROM (SELECT row_number() OVER () AS item, item_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM benchmark)
), held AS (
  SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM sized) SEMI JOIN items USING (term) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, corpus GROUP BY term, n_docs
), impacts AS (
  SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // all_terms))) AS value
  FROM held JOIN weights USING (term), corpus
), scored AS (
  SELECT item, item_id, doc, doc_id, sum(value)::BIGINT AS score FROM items JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
""",
    "op13_metric_join": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), links AS (
  SELECT a.r AS x, b.r AS y FROM (SELECT * FROM v WHERE ok) a JOIN (SELECT * FROM v WHERE ok) b
    ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT r, r AS s FROM v UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.s
), parts AS (
  SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.s GROUP BY reach.r
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.r) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN parts USING (r)
""",
}
