"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontamination, embedding_dedup, html_text, language, ngram, periodic_runs, vector_codes
from driftline.llm.mixing import mix
from driftline.llm.packing import pack
from driftline.llm.quality import quality_rules
from driftline.llm.sharding import shard_documents
from driftline.llm.simhash import near_duplicates
from driftline.llm.token_files import read_tokens, write_tokens
from driftline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality_rules(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary()))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"), carry=("label",))
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_ngram_score": op2_ngram_score,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

def _vector_code_sql(rounds: int = 4) -> str:
    """A part is a row with its vector, position and list of integers; each round adds a table of assignments and one of codebooks."""
    nearest = "SELECT a.k, a.position, a.part, b.entry, list_sum(list_transform(list_zip(a.part, b.part), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance FROM parts a JOIN book{0} b ON a.position = b.position QUALIFY row_number() OVER (PARTITION BY a.k, a.position ORDER BY distance, b.entry) = 1"
    tables = [
        """whole AS (
            SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (SELECT k, p AS position, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS part FROM whole, range(4) r(p)),
        book0 AS MATERIALIZED (SELECT position, k AS entry, part FROM parts WHERE k < 256)"""
    ]
    for i in range(rounds):
        tables.append(f"near{i} AS MATERIALIZED ({nearest.format(i)})")
        tables.append(f"""sums{i} AS (
            SELECT position, entry, list(mean ORDER BY j) AS part FROM (
                SELECT position, entry, j, floor(sum(part[j])::DOUBLE / count(*))::BIGINT AS mean FROM near{i}, range(1, (SELECT max(len(part)) FROM parts) + 1) r(j) GROUP BY ALL
            ) GROUP BY ALL
        ), book{i + 1} AS MATERIALIZED (SELECT position, entry, coalesce(s.part, b.part) AS part FROM book{i} b LEFT JOIN sums{i} s USING (position, entry))""")
    tables.append(f"near{rounds} AS MATERIALIZED ({nearest.format(rounds)})")
    tables.append(f"found AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, sum(distance)::BIGINT AS error FROM near{rounds} GROUP BY k)")
    tables.append(f"hash AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM book{rounds})")
    return "WITH " + ", ".join(tables) + " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM whole JOIN found USING (k), hash"


#: A stretch of 16 or more equal words a lag apart is a chain of equal windows of 16; the CRC-32 goes bit by bit.
_RUNS_SQL = r"""
    WITH bits AS (SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(b)),
    crc AS (SELECT list(c ORDER BY b) AS t FROM bits),
    d AS (
        SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w,
               xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda c, x: xor(t[(xor(c, x) & 255)::INTEGER + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT AS h
        FROM documents, crc
    ), e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
    f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
    docs AS MATERIALIZED (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[(a + (i - 1 - a) % p)::BIGINT + 1] END) END AS w FROM f),
    grams AS MATERIALIZED (SELECT k, n, i, hash(w[i + 1:i + 16]) AS g FROM (SELECT k, n, w, unnest(range(n - 15)) AS i FROM docs WHERE n >= 24)),
    pairs AS (SELECT x.k, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.k = y.k AND x.g = y.g AND y.i > x.i AND (y.i - x.i) * 3 <= x.n),
    chains AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS c FROM pairs),
    stretches AS (SELECT k, q, min(i) AS s, count(*) + 15 + q AS length FROM chains GROUP BY k, q, c),
    runs AS MATERIALIZED (SELECT k, s, length, min(q) AS q FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length::DOUBLE / q DESC, s, q) = 1),
    listed AS (SELECT k, count(*) AS n_runs, string_agg(concat_ws(',', s, length, q) || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY k),
    dropped AS (SELECT DISTINCT k, unnest(range(s + q, s + length)) AS i FROM runs),
    left_over AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS words FROM (SELECT k, unnest(w) AS x, unnest(range(n)) AS i FROM docs) ANTI JOIN dropped USING (k, i) GROUP BY k)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, length * 1000 // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
    FROM docs LEFT JOIN best USING (k) LEFT JOIN listed USING (k) LEFT JOIN left_over USING (k)
"""

#: Where SQL can't express an operator, tests hold it against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op10_embedding_dedup": """
        WITH RECURSIVE unit AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach(a, b) AS (
            SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        )
        SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links,
               least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS kept
        FROM embeddings e
    """,
    "op11_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS passage
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), places AS (
            SELECT k, size, i, array_to_string(w[i:i + size - 1], ' ') AS passage
            FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
        ), occurs AS (SELECT k, item_id, i, size FROM places JOIN windows USING (size, passage)),
        hit AS (SELECT k, count(DISTINCT word) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT k, i, size FROM occurs)) GROUP BY k),
        items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM occurs WHERE item_id IS NOT NULL) GROUP BY k)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
    """,
    "op12_vector_codes": _vector_code_sql(),
    "op13_periodic_runs": _RUNS_SQL,
}
