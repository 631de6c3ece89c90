"""The registered queries of this subpackage: each applies an operator to its whole table.

What they give for nulls, empty and very long texts, ties, repeated rows and empty tables is what their
operators say; columns that an operator doesn't name are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import jaccard, language, licenses, lm, packing, quality, sampling, substrings, topk, warc
from helixframe.runtime import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public vocabulary file's place; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence passages of documents, by a Dice coefficient of 0.8."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of documents."""
    return quality.assess(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back by their index."""
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents by a model of nine tenths of them (null ids are learned from)."""
    return lm.score(_table(spark, sf_dir, "documents"), _remainder(10) == 0)


def _remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents by a model of three quarters of those with a label (rows of null id are not learned from)."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_remainder(4) != 2), language.load_pieces(vocabulary("piece_bpe_32k.model")))
    return language.predict(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that other documents, or the same one, have before."""
    return substrings.repeated_spans(_table(spark, sf_dir, "documents")).drop("_text")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document: their ids, with count and checksum."""
    return sampling.sample_segmentations(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece_sampling": op10_sentencepiece_sampling,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ONLY = r"length(regexp_replace(coalesce(text, ''), '[^{}]', '', 'g'))"

SQL: dict[str, str] = {
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
        pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM d),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM pos),
        rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1) GROUP BY doc_id),
        lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                CAST({_ONLY.format('#*$%&|<>')} AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_lines, CAST(coalesce(l.n - l.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                {_ONLY.format('!')} AS excl, {_ONLY.format('A-Z')} AS up, {_ONLY.format('a-z')} AS low, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS alpha
              FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines l USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * excl > 20 * n_words OR 100 * up > 50 * (up + low) OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * alpha < 70 * n_words OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words) AS kept
        FROM b""",
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to FROM f""",
}
