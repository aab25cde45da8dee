"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuzzy_lines, hard_negatives, importance_sampling, language_id, packing, quality_rules, sentence_pieces, simhash, spelling, toxicity, url_filter, warc, winnowing
from ._common import scratch_path, table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl, final = scratch_path(spark, "warc-crawl"), scratch_path(spark, "warc-final")
    warc.write_archive(warc.crawl_records(table(spark, sf_dir, "pages")), crawl)
    warc.deduplicate(spark, crawl, final)
    return warc.read_archive(spark, final, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.annotate(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.train(docs.where(~out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op4_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return importance_sampling.resample(table(spark, sf_dir, "documents"), good)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnowing.judge(winnowing.spans(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), winnowing.items_digest("items").alias("items_sha256"), "contaminated"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(e.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vec")), F.col("id") % 100 == 0)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentence_pieces.round_trip(docs, public_tokenizers.path(PIECES))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=97)


def _quality_sql() -> str:
    stop = ", ".join(f"'{form}'" for w in dict.fromkeys(quality_rules.STOP_WORDS) for form in (w, w.capitalize(), w.upper()))
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
    m AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop
      FROM w LEFT JOIN cov USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2 AND 20, true)
           AND coalesce(n_symbols / nullif(n_words, 0) <= 0.1, true) AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.6, true)
           AND coalesce((n_stop + 1.0) / nullif(n_words, 0)::DOUBLE >= 0.01, true) AS kept
    FROM b"""


_PAGES_SQL = """
    WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hx FROM h),
    b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hx, (1 + 5 * (k // 4))::BIGINT, 5))::BIGINT >> (5 * (3 - k % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest
          FROM s),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS low FROM b)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = low OR low IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to FROM m"""

_URL_SQL = """
    WITH r(host, path, verdict) AS (VALUES {rules}),
    u AS (SELECT page_id,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    j AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
            row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
          FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
    SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM j WHERE k = 1"""

_WINNOW_SQL = r"""
    WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
    iw AS (SELECT item_id, n, array_to_string(w[p:p+n-1], ' ') AS k
           FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
    ns AS (SELECT DISTINCT n FROM iw),
    dw AS (SELECT doc_id, p, n, array_to_string(w[p:p+n-1], ' ') AS k
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns)),
    hit AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
    cov AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS o FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

_NEGATIVES_SQL = """
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, list_inner_product(a.v, c.v)::BIGINT AS score
          FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

_SPELLING_SQL = """
    WITH RECURSIVE tab AS (
      SELECT list(c ORDER BY k) AS t FROM (
        SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS k))),
    r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
    h AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
            [4294967295] || list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END AS h
          FROM (SELECT *, hex(encode(doc_id || ':' || run)) AS hx FROM r), tab),
    c AS (SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
          GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
    i AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM c),
    cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM i),
    near AS (
      SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN c b ON a.k = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN c b ON a.k = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
    f AS (SELECT c.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
          FROM c LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.at AS root FROM f JOIN walk USING (word) JOIN f AS e ON e.word = walk.at WHERE e.form IS NULL"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_quality_rules, op3_language, op4_resample, op5_urls, op6_simhash, op7_lines, op8_contamination, op9_toxicity, op10_packing,
        op11_negatives, op12_pieces, op13_spelling,
    )
}

ORACLE: dict[str, str] = {
    "op1_warc": _PAGES_SQL,
    "op2_quality_rules": _quality_sql(),
    "op5_urls": _URL_SQL.format(rules=", ".join(str(r) for r in url_filter.RULES), default=url_filter.DEFAULT),
    "op8_contamination": _WINNOW_SQL,
    "op11_negatives": _NEGATIVES_SQL,
    "op13_spelling": _SPELLING_SQL,
}
