"""One query per operator over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from alignframe.llm import (
    crosspolytope, kneser, maintext, mixing, quality, sentencepieces, simhash, spelling, tokenfiles, topk, toxicity, warc, whitening,
)
from alignframe.llm.common import crc_mod, reachable, table

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reachable(spark)
            return fn(spark, sf_dir)

        LLM_QUERIES[name] = run
        return fn

    return register


@F.arrow_udf(LongType())
def _crc32_of_ids(ids: pa.Array) -> pa.Array:
    numbers = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    ends = 4 * np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    return pa.array([zlib.crc32(numbers[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], type=pa.int64())


@query("op1_sentencepiece")
def op1(spark, d):
    """Ids of every whole text, their checksum, and whether they decode to the text again."""
    pieces = sentencepieces.Pieces.read(tokenizer_path("piece_bpe_32k.model"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    decoded = sentencepieces.decode(sentencepieces.encode(docs, pieces), pieces)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        _crc32_of_ids("ids").alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query("op2_mixing")
def op2(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_top_k")
def op3(spark, d):
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_token_files")
def op4(spark, d):
    return tokenfiles.token_files(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op5_cross_polytope")
def op5(spark, d):
    return crosspolytope.near_duplicates(table(spark, d, "embeddings"))


@query("op6_toxicity")
def op6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, d, "labels"))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_simhash")
def op7(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


@query("op8_warc")
def op8(spark, d):
    """Pages bear no time of capture; their ids count seconds from a fixed moment instead."""
    pages = table(spark, d, "pages")
    return warc.archive(pages, F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1_700_000_000))


@query("op9_kneser_ney")
def op9(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model = kneser.train(docs.where(~held_out))
    return kneser.score(docs, model, F.col("text"), [F.col("doc_id"), held_out.alias("held_out")])


@query("op10_quality")
def op10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, d, "labels"))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op11_whitening")
def op11(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


@query("op12_spelling")
def op12(spark, d):
    return spelling.variants(table(spark, d, "documents"))


@query("op13_main_text")
def op13(spark, d):
    return maintext.main_text(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


# Shuffle order, running totals, targets and the merged packets by window functions over whole tables.
LLM_ORACLES["op2_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5('0:' || coalesce(doc_id::VARCHAR, '')) AS ord
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sized GROUP BY source
), levels AS (
    SELECT *, 2 * source_size AS lim,
        (sum(source_size) OVER () * 1.5::DOUBLE
            - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
), reached AS (
    SELECT min_by(level, (lim / weight::DOUBLE, place)) AS level FROM levels WHERE level <= lim / weight::DOUBLE
), targets AS (
    SELECT s.source, s.source_size, least(coalesce(r.level * s.weight, s.lim::DOUBLE), s.lim::DOUBLE) AS target
    FROM levels s LEFT JOIN reached r ON true
), queued AS (
    SELECT row_number() OVER () AS n, z.doc_id, z.size, t.source_size, t.target, coalesce(sum(z.size) OVER (PARTITION BY z.source
        ORDER BY ('0x' || substr(ord, 1, 8))::UBIGINT % 512, ord, doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source
), numbered AS MATERIALIZED (
    SELECT n, size, target, before + r * source_size AS start, unnest(range(1, (size + 63) // 64 + 1)) AS k FROM queued, range(2) AS repeats(r)
), packets AS MATERIALIZED (
    SELECT n, least(k * 64, size) - (k - 1) * 64 AS words, (start + least(k * 64, size)) / target AS finish FROM numbered WHERE target > 0
), merged AS (
    SELECT finish, sum(words) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM packets
), cut AS (
    SELECT max(finish) AS finish FROM merged WHERE upto <= (SELECT floor(round(sum(target::DECIMAL(28, 6)), 3)) FROM targets)
), sent AS (
    SELECT n, sum(words) AS words FROM packets WHERE finish <= (SELECT finish FROM cut) GROUP BY n
)
SELECT doc_id, size, source_size, target, coalesce(words, 0)::BIGINT AS taken FROM queued LEFT JOIN sent USING (n)"""


# base32 of the digest: 160 bits from its hexadecimal form, five at a time. The history is one sort over all pages.
LLM_ORACLES["op8_warc"] = r"""
WITH hashed AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex, 1700000000 + coalesce(page_id, 0) AS captured,
        regexp_extract(nullif(url, ''), '^[a-zA-Z]+://([^/?#:]*)(:[0-9]+)?([^?#]*)([?][^#]+)?', ['host', 'port', 'path', 'query']) AS u
    FROM pages
), keyed AS (
    SELECT *, CASE WHEN u IS NULL THEN '' ELSE lower(array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www[.]', ''), '.')), ',')
        || CASE WHEN u.port IN (':80', ':443') THEN '' ELSE u.port END || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query) END AS url_key
    FROM hashed
), bits AS (
    SELECT page_id, url_key, captured::BIGINT AS captured, octet_length(payload)::BIGINT AS payload_bytes, hex,
        row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST) - 1 AS history_position,
        list_aggregate(list_transform(range(40), lambda i: right('000' || bin(strpos('0123456789abcdef', substr(hex, i::INT + 1, 1)) - 1), 4)), 'string_agg', '') AS bits,
        max(page_id) OVER (PARTITION BY hex) AS largest
    FROM keyed
)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(5), lambda j: substr(bits, (5 * i + j + 1)::INT, 1)::INT * (16 >> j::INT)))::INT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < largest THEN largest END AS refers_to, url_key, captured, history_position
FROM bits"""

# Every query against every other row.
LLM_ORACLES["op3_top_k"] = r"""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.w, v.w)::BIGINT AS score
    FROM whole q JOIN whole v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""

# Links, then the smallest row reachable, by repeated joins.
LLM_ORACLES["op5_cross_polytope"] = r"""
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degrees AS (
    SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(d.n_links, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN degrees d ON e.vec_id = d.a"""
