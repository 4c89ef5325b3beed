"""Queries over whole tables and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_dedup, decontamination, exact_dedup, licences, near_dedup, private, quality, shared, substring_dedup, toxicity
from .kernels import ragged


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(shared.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def token_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids and decoded bytes; ids are written out for a whole batch at once."""
    said = np.frombuffer("".join(f"{i}," for i in range(70_000)).encode(), dtype=np.uint8)
    lengths = np.array([len(str(i)) + 1 for i in range(70_000)])
    firsts = np.cumsum(lengths) - lengths
    for batch in batches:
        ids, decoded = batch.column("ids"), batch.column("decoded")
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        text = memoryview(said[ragged(firsts[flat], lengths[flat])])
        cuts = np.concatenate(([0], np.cumsum(lengths[flat])))[ends].tolist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array([hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts, cuts[1:])], type=pa.string()),
                pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], type=pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(
        shared.table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        then=token_digests,
        schema=DIGESTS,
    )


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(shared.table(spark, sf_dir, "documents"))


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.pseudonymised(shared.table(spark, sf_dir, "documents"), key="example key of a test corpus")


def op2_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = byte_dedup.byte_dedup(shared.table(spark, sf_dir, "documents"), window=50, keep_bytes=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "distance")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(shared.table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(shared.table(spark, sf_dir, "documents"), window=35, keep_text=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_byte_dedup": op2_byte_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_private": op10_private,
}

ORACLE_SQL: dict[str, str] = {
    "op1_licences": licences.oracle(),
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op6_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
                ELSE array_to_string(w[i:i + 2], ' ') END AS g, len(w) < 3 AS short
            FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
            FROM s a JOIN s b ON a.g = b.g AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
        r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
        m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM d JOIN m ON d.doc_id = m.id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
            FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(0, 35)) AS j)),
        k AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN k.n IS NULL THEN w ELSE
                list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
}
