"""The queries of this subpackage and, where DuckDB can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import BASE, listed, secret_scan

    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    count = lambda n: F.size(F.filter("spans", lambda s: s["number"] == n)).cast("long")
    return found.select("doc_id", *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).drop("text_hash")


def remainder(n: int):
    """crc32 of the id as text, modulo n: what deals rows to learning and holding out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    found = toxicity(docs, model)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm_scoring import lm_scores

    found = lm_scores(table(spark, sf_dir, "documents"), remainder(5) != 1)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_codec import merges_digested
    from tessera.llm.tokenizer import vocabulary

    return merges_digested(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), size=5, percent=80)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_token_counts, op4_quality_rules, op5_minhash_near_dedup, op6_sentencepiece, op7_toxicity, op8_warc, op9_lm_scoring, op10_document_fingerprints, op11_source_divergence, op12_vector_codes, op13_ngram_jaccard_join)}
#: Base32 in SQL: each 10 of the 40 hex digits of SHA-1 are 8 letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT >> {35 - 5 * i}) & 31)::INT, 1)" for k in range(4) for i in range(8))



def _codebook_rounds(width: int, turns: int) -> str:
    """CTEs: a<k> assigns each part to its nearest entry of b<k>, b<k + 1> holds the floored means. Parts are `width` long."""
    square = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in range(1, width + 1))
    floored = ", ".join(f"((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in range(1, width + 1))
    out = []
    for k in range(turns + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT id, part, x, m.entry AS entry, m.d AS d FROM (SELECT p.id, p.part, any_value(p.x) AS x, min({{'d': {square}, 'entry': b.entry}}) AS m FROM p JOIN b{k} b USING (part) GROUP BY p.id, p.part))")
        if k < turns:
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, entry, [{floored}] AS x FROM a{k} GROUP BY part, entry) n USING (part, entry))")
    return ", ".join(out)


def _groups(size: int, percent: int) -> str:
    """CTE d: doc_id, n_shingles and component_id of each document, by all pairs that share a shingle; for unique ids."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
        reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
        least_reached AS (SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY a),
        d AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_reached USING (doc_id))"""


ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": f"WITH RECURSIVE {_groups(3, 85)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM d",
    "op13_ngram_jaccard_join": f"WITH RECURSIVE {_groups(5, 80)} SELECT doc_id, n_shingles, component_id FROM d",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM q""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
        terms AS (SELECT id, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words),
        kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
        groups AS (SELECT DISTINCT lang, source FROM d),
        shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
                   FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
                   LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        rated AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM rated))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op12_vector_codes": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        p AS MATERIALIZED (SELECT id, vec_id, part, [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding[4 * part + 1:4 * part + 4]] AS x FROM v, (SELECT unnest(range(16)) AS part)),
        b0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p) WHERE rank <= 64),
        {_codebook_rounds(4, 2)},
        codes AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY id),
        labelled AS (SELECT vec_id, label, code, error FROM v JOIN codes USING (id)),
        digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM labelled, digest""",
}
