"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, chunking, jaccard, leaks, lines, merkle, neighbours, pages, pieces, quality, suffixes, tokens, vectors
from .common import new_folder, table


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its lines before, those removed, the runs, and the text left."""
    return lines.line_dedup(table(spark, folder, "documents")).select(
        "doc_id",
        F.col("line_dedup_lines").alias("n_lines"),
        F.col("line_dedup_removed").alias("n_removed"),
        F.col("line_dedup_runs").alias("n_runs"),
        "text",
    )


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_dedup(table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score_documents(docs, model)


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(table(spark, folder, "pages"))


def op7_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "ids")
    tokens.write_ids(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return tokens.read_ids(spark, path)


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, folder, "documents"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the number of ids, their CRC-32, and whether they decode to the text."""
    docs = table(spark, folder, "documents")
    return pieces.round_trips(docs, vocabulary("piece_bpe_32k.model"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every (document, item) pair of which a passage holds the item."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"
    )


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return align.align_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every row proved against the root, half of them with the line ends of their texts lost."""
    docs = table(spark, folder, "documents")
    kept = F.replace("text", F.lit("\n"), F.lit(""))
    lost = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = [F.when(lost, kept).otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    return merkle.manifest(docs, docs.withColumn("_leaf", merkle.row_digest(*found)))


def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of each vector whose id 20 divides, by inner product."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_line_dedup": op2_line_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_token_id_output": op7_token_id_output,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_decontamination": op10_decontamination,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


_LINE_DEDUP = f"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS all_lines FROM documents
), l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n, pos, line,
         len(regexp_extract_all(line, '{lines.WORD}')) AS words
  FROM (SELECT doc_id, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS pos FROM d)
  WHERE length(trim(line, ' ')) > 0
), w AS (
  SELECT doc_id, n, {lines.MIN_LINES} AS width,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS body
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY n)
  UNION ALL
  SELECT doc_id, n, 1, line FROM l WHERE words >= {lines.LONG_WORDS}
  UNION ALL
  SELECT doc_id, n, 2, body FROM (
    SELECT doc_id, n, line || chr(10) || lead(line, 1) OVER o AS body, words + lead(words, 1) OVER o AS words
    FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY n))
  WHERE words >= {lines.LONG_WORDS}
), later AS (
  SELECT doc_id, n, width FROM (
    SELECT *, row_number() OVER (PARTITION BY width, body ORDER BY doc_id, n) AS nth
    FROM w WHERE body IS NOT NULL)
  WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(n, n + width)) AS n FROM later
), runs AS (
  SELECT doc_id, count(*) AS n_removed,
         count(*) FILTER (WHERE NOT before) AS n_runs
  FROM (SELECT doc_id, n, coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY n) = n - 1, false) AS before
        FROM gone)
  GROUP BY doc_id
), spans AS (
  -- removed stretches of lines of the text, blank lines inside a run included
  SELECT doc_id, min(pos) AS a, max(pos) AS z FROM (
    SELECT g.doc_id, l.pos, g.n - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.n) AS run
    FROM gone g JOIN l ON l.doc_id = g.doc_id AND l.n = g.n)
  GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, list({{'a': a, 'z': z}}) AS s FROM spans GROUP BY doc_id
), full_lines AS (
  SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_runs, 0) AS n_runs,
       CASE WHEN s IS NULL THEN text ELSE array_to_string(
         list_filter(d.all_lines, lambda x, i: len(list_filter(s, lambda y: i - 1 BETWEEN y.a AND y.z)) = 0),
         chr(10)) END AS text
FROM d LEFT JOIN full_lines USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


def _form(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _step(pos: str) -> str:
    """Siblings of a row's node on a level, `left|right`."""
    i = f"({pos} // (3 ** level)::BIGINT)"
    return (
        f"array_to_string(nodes[{i} // 3 * 3 + 1 : {i}], '') || '|' || "
        f"array_to_string(nodes[{i} + 2 : {i} // 3 * 3 + 3], '')"
    )


_MERKLE = f"""
WITH RECURSIVE bit AS (
  SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)),
      lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(256)) AS b))
), d AS (
  SELECT *, coalesce('=' || source, '') AS g,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])) % 2 = 1 AS lost
  FROM documents, bit
), h AS (
  SELECT *, sha256(head || {_form('text')}) AS leaf,
    sha256(head || CASE WHEN lost THEN {_form("replace(text, chr(10), '')")} ELSE {_form('text')} END) AS found
  FROM (SELECT *, {_form('doc_id')} || {_form('source')} || {_form('lang')} || {_form('n_chars')} AS head FROM d)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos FROM h
), tree AS (
  SELECT g, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY g
  UNION ALL
  SELECT g, level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM tree WHERE len(nodes) > 1
), sub AS (
  SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM top WHERE len(nodes) > 1
), step AS (
  SELECT g, pos, list(s ORDER BY level) AS steps FROM (
    SELECT l.g, l.pos, level, {_step('l.pos')} AS s FROM leaves l JOIN tree ON tree.g = l.g WHERE len(nodes) > 1)
  GROUP BY g, pos
), upper AS (
  SELECT g, list(s ORDER BY level) AS steps FROM (
    SELECT g, level, {_step('pos')} AS s FROM sub, top WHERE len(nodes) > 1)
  GROUP BY g
), way AS (
  SELECT l.doc_id, l.leaf, l.found, sub.subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
         list_concat(coalesce(step.steps, []), coalesce(upper.steps, [])) AS steps
  FROM leaves l JOIN sub ON sub.g = l.g
  LEFT JOIN step ON step.g = l.g AND step.pos = l.pos LEFT JOIN upper ON upper.g = l.g
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend(found, steps),
        lambda x, s: sha256(string_split(s, '|')[1] || x || string_split(s, '|')[2])) AS folded_root FROM way)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _LINE_DEDUP, "op12_merkle_manifest": _MERKLE}
