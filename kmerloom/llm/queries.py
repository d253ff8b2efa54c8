"""Registered corpus queries: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm._common import new_path, table
from kmerloom.llm.alignment import link_measures
from kmerloom.llm.bpe import decode_bpe, encode_bpe
from kmerloom.llm.chat import rotate_perspectives
from kmerloom.llm.collocations import collocations
from kmerloom.llm.decontaminate import contamination
from kmerloom.llm.line_dedup import line_dedup
from kmerloom.llm.media import media_features, store_texts, write_tiles
from kmerloom.llm.packing import pack_documents
from kmerloom.llm.quality import fit_quality, held_out, score_quality
from kmerloom.llm.simhash import simhash_components
from kmerloom.llm.substring_dedup import substring_dedup
from kmerloom.llm.suffix_dedup import suffix_dedup
from kmerloom.llm.token_records import read_records, write_records


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumn("spans", spans)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_tiles(media_features(store_texts(table(spark, sf_dir, "documents"))))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), root)
    return read_records(spark, root, manifest).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_bpe(encode_bpe(table(spark, sf_dir, "documents")))
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids, F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_measures(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_hilbert_packing": op2_hilbert_packing,
    "op3_perspectives": op3_perspectives,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_media_columns": op6_media_columns,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_token_records": op10_token_records,
    "op11_collocations": op11_collocations,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20),
        windows AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM starts),
        later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
        each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
        kept AS (SELECT e.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
                        string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS s
                 FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
        FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
    """,
    "op3_perspectives": r"""
        WITH base AS (SELECT DISTINCT conv_id, floor(turn / 64)::BIGINT AS block, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
                      FROM conversations WHERE conv_id IS NOT NULL),
        views AS (SELECT DISTINCT conv_id, role AS perspective FROM base),
        parts AS (SELECT conv_id, perspective, block, turn, role, text, role = perspective AS own,
                         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
                         text || '<|im_end|>' || chr(10) AS body
                  FROM base JOIN views USING (conv_id)),
        placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, role, text) AS stop FROM parts)
        SELECT conv_id, perspective, block::BIGINT AS block, count(*)::BIGINT AS n_turns,
               string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS dialogue,
               coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS spans
        FROM placed GROUP BY ALL
    """,
    "op5_line_dedup": r"""
        WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM lines WHERE len(w) >= 3),
        windows AS (SELECT doc_id, p, array_to_string(w[p : p + 2], chr(10)) AS s FROM starts),
        later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS i FROM later),
        each AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS i FROM lines),
        kept AS (SELECT e.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
                        string_agg(e.line, chr(10) ORDER BY e.i) FILTER (g.i IS NULL) AS s
                 FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
        SELECT l.doc_id, coalesce(len(l.w), 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
               CASE WHEN l.text IS NULL THEN NULL ELSE sha256(coalesce(k.s, '')) END AS kept_sha256
        FROM lines l LEFT JOIN kept k ON l.doc_id = k.doc_id
    """,
    "op8_suffix_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (SELECT r, h, unnest(range(1, len(h) // 2 - 198)) AS p FROM docs WHERE len(h) >= 400),
        named AS MATERIALIZED (SELECT r, p, hash(substring(h, 2 * p - 1, 400)) AS s FROM starts),
        again AS (SELECT s FROM named GROUP BY s HAVING count(*) > 1),
        twice AS (SELECT r, p FROM named SEMI JOIN again USING (s)),
        runs AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run
                 FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM twice)) GROUP BY r, run),
        edges AS (SELECT r, a, b, lag(b, 1, 1::BIGINT) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
        kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(h, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) AS s
                 FROM edges JOIN docs USING (r) GROUP BY r)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(s || substring(h, 2 * last - 1), h))) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)
    """,
    "op9_decontamination": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
        starts AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM sized),
        asked AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM starts),
        sizes AS (SELECT DISTINCT n FROM asked),
        places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n),
        found AS (SELECT r, p, places.n, item FROM (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM places) places JOIN asked ON places.s = asked.s AND places.n = asked.n),
        hit AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS i FROM found) GROUP BY r),
        named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM found GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
    """,
    "op11_collocations": r"""
        WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
        pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
        sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
        starts AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, sizes WHERE len(w) >= m),
        grams AS MATERIALIZED (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS s, count(*) AS f FROM starts GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT lang, m, s, string_split(s, ' ') AS w, f AS a FROM grams WHERE m >= 2 AND f >= 30),
        cuts AS (SELECT lang, m, s, a, w, unnest(range(1, m)) AS k FROM candidates),
        valued AS (SELECT c.lang, c.m, c.s, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
                   FROM cuts c JOIN grams x ON x.lang = c.lang AND x.s = array_to_string(c.w[1 : c.k], ' ')
                               JOIN grams y ON y.lang = c.lang AND y.s = array_to_string(c.w[c.k + 1 : c.m], ' ')),
        least AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
        inner_sizes AS (SELECT lang, w, m, a, unnest(range(2, m)) AS q FROM candidates),
        inner_starts AS (SELECT lang, w, a, q, unnest(range(1, m - q + 2)) AS i FROM inner_sizes),
        around AS (SELECT lang, array_to_string(w[i : i + q - 1], ' ') AS s, max(a) AS longer FROM inner_starts GROUP BY ALL),
        kept AS (SELECT v.* FROM least v LEFT JOIN around o ON o.lang = v.lang AND o.s = v.s WHERE o.longer IS NULL OR 100 * o.longer < 80 * v.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(s)) AS rank FROM kept)
        SELECT r.lang, r.rank::BIGINT AS rank, r.s AS phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
        FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
    """,
}
