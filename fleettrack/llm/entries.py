"""Queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("rejected", F.col("p_toxic") >= 0.5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_boilerplate", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has clean turns, which are written as raw transcripts first. Conversations that are held out are parsed only, never learned from."""
    from .transcripts import held_out, learn, recover, spoken_text, transcripts_of

    rows = transcripts_of(table(spark, sf_dir, "conversations"), spoken_text())
    turns = recover(rows, learn(rows.where(~held_out("conv"))))
    return turns.select(F.col("conv").alias("conv_id"), "turn_no", F.col("first_turn").alias("turn"), "role", "n_lines", "rendered", held_out("conv").alias("held_out"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out_rows, learn, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs.where(~held_out_rows())), held_out_rows())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metric_join import range_join

    return range_join(table(spark, sf_dir, "embeddings"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_likelihood import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture_packing": op1_mixture_packing,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_transcripts": op4_transcripts,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_metric_join": op9_metric_join,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
}

SQL: dict[str, str] = {
    "op3_line_dedup": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT source, unnest(a) AS line FROM t),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE length(trim(line, ' ')) >= 10 GROUP BY 1 HAVING count(DISTINCT source) >= 5),
p AS (SELECT r, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM t),
k AS (SELECT p.r, count(*) AS kept, string_agg(p.line, chr(10) ORDER BY i) AS s FROM p LEFT JOIN b ON b.line = trim(p.line, ' ') WHERE b.line IS NULL GROUP BY 1),
o AS (SELECT t.*, len(a) - coalesce(kept, 0) AS bad, CASE WHEN regexp_matches(s, '[^ \t\n\v\f\r]') AND kept < len(a) THEN s END AS s FROM t LEFT JOIN k USING (r))
SELECT doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, CAST(coalesce(bad, 0) AS BIGINT) AS n_boilerplate, CAST(CASE WHEN s IS NULL THEN 0 ELSE bad END AS BIGINT) AS n_removed,
  CAST(length(coalesce(s, text)) AS BIGINT) AS n_kept_chars, md5(coalesce(s, text)) AS text_md5 FROM o""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 4, 1))) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.node AND r.c < e.y)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id GROUP BY 1""",
    "op9_metric_join": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.node AND r.c < l.y),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1), c AS (SELECT node, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON n.x = vec_id""",
}
