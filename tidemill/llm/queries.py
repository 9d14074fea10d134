"""The registered queries of the corpus operators: one a numbered operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, codebooks, codebooks_sql, dialogue, dialogue_sql, hamming, jaccard, langid, mixing, packing, pii, secrets, topk, toxicity, wordbpe
from tidemill.llm.digests import count_of, joined, of_kinds
from tidemill.session import table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def rank_file() -> str:
    """Where the rank file lies on the machine that asks."""
    return public_tokenizers.path(RANKS)


def word_file() -> str:
    """Where the vocabulary with word ends lies on the machine that asks."""
    return public_tokenizers.path(WORDS)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both."""
    return bpe.encode(table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: counts and digest of the base kinds, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(joined(of_kinds(spans, secrets.BASE)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose key is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte ids in training sequences, a row each."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.byte_ids(F.col("text")), width=1, end=packing.BYTE_END)


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and the verdict of every document, by a chain fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.production_categories())
    return toxicity.predict(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose key is divisible by 20."""
    return hamming.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: counts and digest of the base kinds, and all spans."""
    spans = F.col("spans")
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(joined(of_kinds(spans, pii.BASE)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return mixing.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.9 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, num=90, den=100))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of what is left of every conversation, after planted damage."""
    rows = dialogue.rows_of(table(spark, sf_dir, "conversations"))
    return dialogue.report(rows, dialogue.damaged(rows)).withColumnRenamed("conv", "conv_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the errors of its label, and the digest of the codebooks."""
    rows, width = codebooks.scaled(table(spark, sf_dir, "embeddings"), parts=4, scale=1024)
    books = codebooks.fit(rows, width, parts=4, size=256, rounds=4)
    coded = codebooks.with_label_error(codebooks.encode(rows, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text by its distinct words, decode the ids, and give digests of both."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return wordbpe.encode(table(spark, sf_dir, "documents"), word_file).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_pivot_topk": op3_pivot_topk,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_language_crf": op6_language_crf,
    "op7_multi_index_hashing": op7_multi_index_hashing,
    "op8_pii_disclosure": op8_pii_disclosure,
    "op9_context_mixing": op9_context_mixing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_word_bpe": op13_word_bpe,
}

#: SQL that gives the same rows, where SQL can. The others are tested against brute force, a round trip or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_pivot_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM p)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
""",
    "op10_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
b AS (SELECT a.doc_id AS x, c.doc_id AS y, count(*) AS shared FROM s a JOIN s c ON a.g = c.g AND a.doc_id < c.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(k.links, 0) AS n_links
FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = n.doc_id LEFT JOIN (SELECT x, count(*) AS links FROM e GROUP BY x) k ON k.x = n.doc_id
""",
    "op11_conversation_repair": dialogue_sql.SQL,
    "op12_vector_codes": codebooks_sql.sql(),
}
