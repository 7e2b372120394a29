"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .ctw import ctw_score
from .embdedup import embedding_dedup
from .htmltext import html_text
from .linededup import line_dedup
from .minhash import minhash_dedup
from .mixing import mix
from .pieces import encode
from .topk import top_k
from .toxicity import toxicity
from .warc import checked_revisits, read_warc, write_warc


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score(read(spark, sf_dir, "documents"))


VOCABULARY = os.environ.get("CORPUSLOOM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), VOCABULARY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = checked_revisits(read_warc(write_warc(read(spark, sf_dir, "pages")), keep_payload=False))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(read(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text(read(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_ctw": op2_ctw,
    "op3_pieces": op3_pieces,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_embeddings": op7_embeddings,
    "op8_html": op8_html,
    "op9_topk": op9_topk,
    "op10_toxicity": op10_toxicity,
}

ORACLE: dict[str, str] = {
    "op1_lines": r"""
        WITH RECURSIVE ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
        wd AS (SELECT doc_id, line_no, string_split_regex(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS words FROM ln),
        lf AS (SELECT doc_id, line_no, words, list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM wd WHERE words <> ['']),
        kinds AS (SELECT tokens, array_to_string([len(tokens)::VARCHAR] || tokens[1:4], chr(1)) AS leaf, count(DISTINCT doc_id) AS n, min((doc_id, line_no)) AS place FROM lf
            WHERE 100 * len(list_filter(tokens, lambda t: t <> '<*>')) >= 70 * len(tokens) GROUP BY tokens),
        busy AS (SELECT leaf FROM kinds GROUP BY leaf HAVING sum(n) >= 3),
        ranked AS (SELECT leaf, tokens, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, place) AS i FROM kinds JOIN busy USING (leaf)),
        walk(leaf, i, tokens, template, starts) AS (
            SELECT leaf, i, tokens, i, [{'i': i, 't': tokens}] FROM ranked WHERE i = 1
            UNION ALL
            SELECT leaf, i, tokens, coalesce(hit, i), CASE WHEN hit IS NULL THEN list_append(starts, {'i': i, 't': tokens}) ELSE starts END FROM (
                SELECT leaf, i, tokens, starts, CASE WHEN 100 * list_max(same) >= 70 * len(tokens) THEN starts[list_position(same, list_max(same))].i END AS hit FROM (
                    SELECT r.leaf, r.i, r.tokens, w.starts, list_transform(w.starts, lambda s: len(list_filter(range(1, len(r.tokens) + 1), lambda p: s.t[p] = r.tokens[p] AND s.t[p] <> '<*>'))) AS same
                    FROM walk w JOIN ranked r ON r.leaf = w.leaf AND r.i = w.i + 1))),
        hits AS (SELECT doc_id, line_no, leaf, template FROM lf JOIN walk USING (tokens)),
        again AS (SELECT leaf, template, min(doc_id) AS first FROM hits GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
        equal AS (SELECT words, min(doc_id) AS first FROM lf GROUP BY words HAVING count(DISTINCT doc_id) >= CASE WHEN len(words) > 50 THEN 2 ELSE 3 END),
        gone AS (SELECT doc_id, line_no FROM hits JOIN again USING (leaf, template) WHERE doc_id <> first UNION SELECT doc_id, line_no FROM lf JOIN equal USING (words) WHERE doc_id <> first)
        SELECT ln.doc_id, coalesce(string_agg(line, chr(10) ORDER BY ln.line_no) FILTER (WHERE gone.doc_id IS NULL), '') AS text, count(*)::INT AS n_lines, count(gone.doc_id)::INT AS n_dropped
        FROM ln LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.line_no = ln.line_no GROUP BY ln.doc_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact FROM p LEFT JOIN f ON p.html = f.html AND n >= 100""",
    "op6_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [len(w) || ' ' || array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
        r(n, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.n),
        c AS (SELECT n AS doc_id, min(root) AS component_id FROM r GROUP BY n)
        SELECT c.doc_id, coalesce(z.n, 0) AS n_shingles, component_id, component_id = c.doc_id AS kept FROM c LEFT JOIN z USING (doc_id)""",
    "op7_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r(n, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.n),
        c AS (SELECT n AS vec_id, min(root) AS component_id FROM r GROUP BY n)
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, component_id = c.vec_id AS kept FROM c""",
    "op9_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
}
