"""Queries over the given tables, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from judgelens.llm import embedding_dedup, html_text, license_scan, minhash_dedup, mixing, packing, quality, resampling, token_counts, token_files, toxicity, vector_codes, vector_search
from judgelens.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return license_scan.license_report(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match token counts of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model fitted on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b token table of all documents, written and read back."""
    return token_files.token_table(table(spark, sf_dir, "documents"), with_ids=False)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector with all others."""
    return vector_search.search(table(spark, sf_dir, "embeddings"), every=50)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by their likeness to the benchmark texts, a tenth of them drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_html_text": op9_html_text,
    "op10_source_mixing": op10_source_mixing,
    "op11_vector_search": op11_vector_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {}

SQL["op3_embedding_dedup"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM vectors
  UNION
  SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT node AS vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(seen) AS component_id, node = min(seen) AS kept
FROM reach LEFT JOIN counts ON a = node GROUP BY node
"""

SQL["op4_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT edges.b, reach.seen FROM reach JOIN edges ON edges.a = reach.node
)
SELECT node AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id, node = min(seen) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = node GROUP BY node
"""

WHOLE_VECTORS = """
kept AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)"""

SQL["op11_vector_search"] = f"""
WITH {WHOLE_VECTORS}, scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# The checksum byte by byte, over distinct words: a table of 256 values by its rule, then one step a byte.
SQL["op12_importance_resampling"] = r"""
WITH table_values AS (
  SELECT b, list_reduce(range(0, 9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b::BIGINT) AS value
  FROM range(0, 256) t(b)
), crc_table AS (
  SELECT list(value ORDER BY b) AS steps FROM table_values
), texts AS (
  SELECT doc_id, 0 AS target, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark
), cut AS (
  SELECT doc_id, target, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), uses AS (
  SELECT doc_id, target, word, count(*) AS n FROM (SELECT doc_id, target, unnest(words) AS word FROM cut) GROUP BY ALL
), spelled AS (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM uses)
), bytes AS (
  SELECT word, list_transform(range(0, len(digits) // 2), lambda i: ('0x' || substr(digits, (2 * i + 1)::BIGINT, 2))::BIGINT) AS codes FROM spelled
), hashed AS (
  SELECT word, xor(list_reduce(codes, lambda c, x: xor(c >> 8, steps[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), bucket_counts AS (
  SELECT bucket, sum(CASE target WHEN 0 THEN n ELSE 0 END) AS s, sum(CASE target WHEN 1 THEN n ELSE 0 END) AS t FROM uses JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM bucket_counts) + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM bucket_counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM bucket_counts
), weights AS (
  SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM uses JOIN hashed USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM able) THEN place END AS rank, n_features AS n_words
FROM scored LEFT JOIN able USING (doc_id)
"""


def _assigned(book: str, name: str) -> str:
    return f"""{name} AS (
  SELECT vec_id, part, c, entry, d FROM (
    SELECT parts.vec_id, parts.part, parts.c, entry,
      list_sum(list_transform(range(1, len(parts.c) + 1), lambda i: (parts.c[i] - {book}.c[i]) * (parts.c[i] - {book}.c[i])))::BIGINT AS d
    FROM parts JOIN {book} ON parts.part = {book}.part
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
)"""


def _next(book: str, assigned: str, name: str) -> str:
    return f"""{name}_sums AS (
  SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
  FROM (SELECT part, entry, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS place FROM {assigned}) GROUP BY ALL
), {name}_means AS (
  SELECT part, entry, list(x ORDER BY place) AS c FROM {name}_sums GROUP BY ALL
), {name} AS (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN {name}_means m USING (part, entry)
)"""


SQL["op13_vector_codes"] = f"""
WITH {WHOLE_VECTORS}, parts AS (
  SELECT vec_id, part, v[(part * (len(v) // 16) + 1):((part + 1) * (len(v) // 16))] AS c FROM kept, (SELECT unnest(range(0, 16)) AS part)
), starts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64
), book0 AS (
  SELECT part, entry, c FROM parts JOIN starts USING (vec_id)
), {_assigned("book0", "near0")}, {_next("book0", "near0", "book1")}, {_assigned("book1", "near1")}, {_next("book1", "near1", "book2")}, {_assigned("book2", "near2")},
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""
