"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    kept = substring_dedup(table(spark, sf_dir, "documents"), window=20, start=5)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import is_held_out, score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", is_held_out("doc_id", 5).alias("held_out"), F.col("_t_score").alias("score"), F.col("_t_predicted").alias("predicted"), F.col("_t_language").alias("guessed_lang"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    found = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("pii_types").cast("bigint").alias("n_entities"), F.array_join("pii_types", ",").alias("entity_types"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import merkle_manifest

    return merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_toxicity, op4_exact_dedup, op5_lm_scoring, op6_pii_surrogates, op7_packing, op8_source_mixing, op9_warc, op10_lz_fingerprint, op11_ranked_search, op12_ngram_join, op13_merkle_manifest)}



def _near_sql(percent: int, columns: str) -> str:
    """Components of links between 4-word shingle sets, ``percent`` of their union or more in common."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 2))) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS key FROM s GROUP BY 1),
        k AS (SELECT key, min(doc_id) AS class_id FROM n GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(class_id, c.doc_id) AS class_id{columns} FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k USING (key)"""


ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again
              FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
        gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM g, LATERAL (SELECT unnest(range(0, 20)) AS k) WHERE again),
        flat AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
        kept AS (SELECT f.doc_id, string_agg(word, ' ' ORDER BY f.pos) AS t, count(*) AS n FROM flat f ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op2_minhash_near_dedup": _near_sql(80, ", c.doc_id = component_id AS kept"),
    "op12_ngram_join": _near_sql(85, ""),
    "op4_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""",
    "op8_source_mixing": r"""
        WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
        r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c),
        s AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
              FROM r, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k)),
        u AS (SELECT doc_id, source AS src, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(16, 13) AS u FROM documents),
        n AS (SELECT u.doc_id, any_value(s.rate) AS rate, count(*) FILTER (WHERE s.cdf <= u.u) AS draw
              FROM u JOIN s ON s.source IS NOT DISTINCT FROM u.src GROUP BY u.doc_id)
        SELECT d.*, x.replica::INTEGER AS replica, round(n.rate, 6) AS rate, n.draw::INTEGER AS draw
        FROM documents d JOIN n USING (doc_id), LATERAL (SELECT unnest(range(0, n.draw)) AS replica) x""",
    "op11_ranked_search": r"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY ALL),
        g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
        m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM n, g),
        df AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM tf, g GROUP BY term),
        s AS (SELECT q.item_id, tf.doc_id, sum(wt * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score
              FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, lang, n_chars, text,
                 CASE WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 2 = 0
                      THEN replace(text, chr(10), '') ELSE text END AS t
          FROM documents),
        f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
        leaf AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
                        sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS x FROM f),
        l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM leaf),
        t AS (SELECT source, 0 AS lv, i, c, h FROM l
              UNION ALL SELECT source, lv + 1, i // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE c > 1 GROUP BY source, lv, i // 3, c),
        s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM t WHERE c = 1),
        u AS (SELECT 0 AS lv, i, c, h FROM s
              UNION ALL SELECT lv + 1, i // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE c > 1 GROUP BY lv, i // 3, c),
        -- every level of the two trees as one: the leaf's own place in it, and the runs it meets
        steps AS (SELECT l.source, l.i AS leaf, t.lv, l.i // power(3, t.lv)::BIGINT AS own, t.i, t.h, 0 AS tree
                  FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source AND t.c > 1 AND t.i // 3 = l.i // power(3, t.lv + 1)::BIGINT
                  UNION ALL
                  SELECT l.source, l.i, u.lv, s.i // power(3, u.lv)::BIGINT, u.i, u.h, 1
                  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN u ON u.c > 1 AND u.i // 3 = s.i // power(3, u.lv + 1)::BIGINT),
        p AS (SELECT source, leaf, sha256(coalesce(string_agg(h, '' ORDER BY tree, lv, i) FILTER (WHERE i <> own), '')) AS proof FROM steps GROUP BY ALL),
        runs AS (SELECT source, leaf, row_number() OVER (PARTITION BY source, leaf ORDER BY tree, lv) AS k,
                        coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < own), '') AS lft, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > own), '') AS rgt
                 FROM steps GROUP BY source, leaf, tree, lv),
        fold AS (SELECT source, i AS leaf, 0::BIGINT AS k, x FROM l
                 UNION ALL SELECT fold.source, fold.leaf, runs.k, sha256(lft || x || rgt) FROM fold JOIN runs ON runs.source IS NOT DISTINCT FROM fold.source AND runs.leaf = fold.leaf AND runs.k = fold.k + 1),
        ends AS (SELECT source, leaf, arg_max(x, k) AS x FROM fold GROUP BY ALL)
        SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM u WHERE c = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
               ends.x AS folded_root, ends.x = (SELECT h FROM u WHERE c = 1) AS verified
        FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN ends ON ends.source IS NOT DISTINCT FROM l.source AND ends.leaf = l.i
        LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf = l.i""",
}
