"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import align, bpe, html_text, line_dedup, media, mixing, ngram_join, packing, pii, quality_rules, substring_dedup, toxicity, whitening
from orbitframe.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.found(docs, pii.fit(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extracted(pages, html_text.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2("kept_text_", 256).alias("kept_sha256"), F.col("bitmap_").alias("bitmap"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.text_to_media(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), path, decode=True))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.digests(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_pii, op3_packing, op4_substring_dedup, op5_html_text, op6_toxicity, op7_line_dedup, op8_media, op9_quality_rules, op10_mixing, op11_bpe, op12_whitening, op13_token_alignment)}
def _quality_sql() -> str:
    """The base counts, the histograms, the references and the distances of op9 in SQL."""
    classes = ["a-z", r"\x20\x09-\x0D", "A-Z", "0-9", ".,;:!?'\"()-", r"#*$%&|<>@^~_=+/\\{}\[\]`"]
    quoted = [c.replace("'", "''") for c in classes]
    chars = ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in quoted)
    rest = f"length(regexp_replace(t, '[{''.join(q.replace('()-', '()\\-') for q in quoted)}]', '', 'g'))"
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in listed)}]" for lang, listed in quality_rules.COMMON_WORDS.items())
    n, m = len(classes) + 1, max(map(len, quality_rules.COMMON_WORDS.values())) + 1
    sums = ", ".join([f"sum(chars[{i + 1}]) AS c{i}" for i in range(n)] + [f"sum(common[{i + 1}]) AS w{i}" for i in range(m)])

    def distance(a: str, b: str) -> str:
        p, q = f"list_transform({a}, lambda x: x / list_sum({a}))", f"list_transform({b}, lambda x: x / list_sum({b}))"
        term = "CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END"
        return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term})) / 2)) END"

    return rf"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, ws[i:i+2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
        r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1), (VALUES (0), (1), (2)) v(o) GROUP BY 1),
        h AS (SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, length(t) AS n_chars, [{chars}, {rest}] AS chars,
            list_transform(CASE lang {lists} END, lambda w: len(list_filter(ws, lambda x: lower(x) = w))) AS found FROM d),
        f AS (SELECT * EXCLUDE (lines, found), len(lines) - len(list_distinct(lines)) AS n_dup_lines, list_append(found, n_words - list_sum(found)::BIGINT) AS common FROM h),
        s AS (SELECT lang, {sums} FROM f GROUP BY lang),
        j AS (SELECT f.*, coalesce(r.n, 0) AS n_repeat_words, [{", ".join(f"c{i}" for i in range(n))}] AS rc, CASE WHEN w0 IS NOT NULL THEN [{", ".join(f"w{i}" for i in range(m))}] END AS rw
            FROM f LEFT JOIN r USING (doc_id) LEFT JOIN s ON s.lang IS NOT DISTINCT FROM f.lang),
        k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_chars >= {quality_rules.MIN_CHARS} THEN round({distance("chars", "rc")}, 6) END AS char_distance,
            CASE WHEN list_sum(common) >= {quality_rules.MIN_TOKENS} THEN round({distance("common", "rw")}, 6) END AS word_distance FROM j)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT coalesce(char_distance > {quality_rules.MAX_CHAR_DISTANCE}, false) AND NOT coalesce(word_distance > {quality_rules.MAX_WORD_DISTANCE}, false) AS kept, char_distance, word_distance FROM k
    """


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(k, '|' ORDER BY k)) AS own FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b, x.own AS own_a, y.own AS own_b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
        t AS (SELECT node, min(reach) AS class_id FROM r GROUP BY 1),
        l AS (SELECT a, count(*) AS n_links, count(DISTINCT own_b) FILTER (own_b <> own_a) AS n_text_links FROM e GROUP BY 1)
        SELECT node AS doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links FROM t LEFT JOIN l ON a = node
    """,
    "op9_quality_rules": _quality_sql(),
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
        f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM (SELECT w.doc_id, i FROM w JOIN f USING (k) WHERE first < w.doc_id), (SELECT unnest(range(50)) AS o)),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
        x AS (SELECT t.*, g.pos IS NOT NULL AS g, lag(g.pos) OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS before FROM t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos)
        SELECT d.doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (g) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY x.pos) FILTER (NOT g), '')) AS kept_sha256, count(*) FILTER (g AND before IS NULL) AS n_spans
        FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
    """,
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents))
        ),
        common AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT doc_id, pos, line, c.k IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN common c USING (k)),
        runs AS (SELECT doc_id, gone, min(pos) AS head, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS run FROM judged) GROUP BY doc_id, gone, run),
        bits AS (SELECT doc_id, (CASE WHEN bool_or(gone AND head = 1) THEN '0,' ELSE '' END) || string_agg(n, ',' ORDER BY head) AS bitmap FROM runs GROUP BY 1)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256, any_value(bitmap) AS bitmap
        FROM judged JOIN bits USING (doc_id) GROUP BY doc_id
    """,
}
