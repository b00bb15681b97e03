"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import decontaminate, exact_search, html_text, kd_shards, language_id, merkle, packing, pii, secret_scan, toxicity, warc, whitening
from wayline.llm.near_dedup import near_duplicates

TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file is."""
    if TOKENIZERS not in sys.path:
        sys.path.append(TOKENIZERS)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.learn(documents))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles at four fifths."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=24)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by way of ARC to WARC files and back."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document with up to six edits in a hundred characters."""
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of each fiftieth vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vector"), F.col("embedding").alias("raw"))
    # floor() makes a long of its argument, so components that aren't finite are told by the input.
    finite = rows.where("raw is not null and forall(raw, x -> x is not null and abs(x) < double('infinity'))")
    return exact_search.top_k(finite.where("vec_id % 50 = 0"), finite, k=5)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and verification in one manifest by source."""
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the first eight whitened components, fitted to all of them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.whole_numbers(F.col("embedding")).alias("x"))
    white = whitening.transform(rows, whitening.fit(rows, components=8))
    # A deviation that no long holds (from some hundred thousand rows with wide spreads on) is null here; the operator has it whole.
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by its nearest labelled examples, learned from documents that aren't held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.score(documents, toxicity.learn(documents, labels.where(~held_out)), held_out)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_kd_shards": op4_kd_shards,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_html_text": op7_html_text,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_exact_search": op10_exact_search,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS holder FROM p),
        bits AS (
            SELECT *, list_transform(range(0, 40), lambda i: (position(substr(hex, i + 1, 1) IN '0123456789abcdef') - 1)) AS nibbles FROM s
        ),
        flat AS (
            SELECT *, list_transform(range(0, 160), lambda i: (nibbles[i // 4 + 1] >> (3 - i % 4)) & 1) AS b FROM bits
        )
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(16 * b[5 * i + 1] + 8 * b[5 * i + 2] + 4 * b[5 * i + 3] + 2 * b[5 * i + 4] + b[5 * i + 5] + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
        FROM flat
    """,
    "op10_exact_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS c FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.c, e.c) AS BIGINT) AS score
            FROM v q JOIN v e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id
        ),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, lang, n_chars, text,
                   coalesce(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                       lambda s, b: list_reduce(range(0, 8), lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, xor(s, b)), 4294967295), 4294967295) % 5 = 0, false) AS hit
            FROM documents
        ),
        e AS (
            SELECT *, concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                             coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
                   coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
            FROM d
        ),
        h AS (SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN hit THEN sha256(head || lowered) ELSE sha256(head || body) END AS changed FROM e),
        l AS (
            SELECT doc_id, leaf, changed, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
            FROM h
        ),
        t(g, lvl, idx, h, n) AS (
            SELECT g, 0, pos, leaf, n FROM l
            UNION ALL
            SELECT g, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY g, lvl, idx // 16, n
        ),
        sub AS (SELECT g, h FROM t WHERE n = 1),
        u(lvl, idx, h, n) AS (
            SELECT 0, g, h, (SELECT count(*) FROM sub) FROM sub
            UNION ALL
            SELECT lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, idx // 16, n
        ),
        -- What stands before and after each node in its run.
        ts AS (SELECT g, lvl, idx, coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                      coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM t WHERE n > 1),
        us AS (SELECT lvl, idx, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                      coalesce(string_agg(h, '') OVER (PARTITION BY lvl, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM u WHERE n > 1),
        tw AS (SELECT l.g, l.pos, list(ts.b || '|' || ts.a ORDER BY ts.lvl) AS way FROM l JOIN ts ON ts.g = l.g AND ts.idx = l.pos // CAST(pow(16, ts.lvl) AS BIGINT) GROUP BY l.g, l.pos),
        uw AS (SELECT sub.g, list(us.b || '|' || us.a ORDER BY us.lvl) AS way FROM sub JOIN us ON us.idx = sub.g // CAST(pow(16, us.lvl) AS BIGINT) GROUP BY sub.g),
        p AS (
            SELECT l.doc_id, l.leaf, l.changed, sub.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(tw.way, []), coalesce(uw.way, [])) AS way
            FROM l JOIN sub USING (g) LEFT JOIN tw USING (g, pos) LEFT JOIN uw USING (g)
        ),
        f AS (
            SELECT *, sha256(replace(array_to_string(way, ''), '|', '')) AS proof_sha256,
                   list_reduce(list_prepend(changed, way), lambda s, x: sha256(split_part(x, '|', 1) || s || split_part(x, '|', 2))) AS folded_root
            FROM p
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
    """,
}
