"""The opN_ queries over the whole synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    # rows that repeat id and text are one document of the operator, and as many rows of the result
    out = exact_dedup(_table(spark, sf_dir, "documents")).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    out = archive_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), unnamed=True)
    refers = F.regexp_extract("capture.refers_to", r":(-?\d+)(?:\.\d+)?>$", 1)
    return out.select(
        "page_id", "capture.payload_bytes", "capture.payload_digest", "capture.record_type",
        F.when(F.col("capture.refers_to").isNotNull(), refers).cast("long").alias("refers_to"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    out = mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    return score(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair

    rows = _table(spark, sf_dir, "conversations")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    damaged = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))))
    return repair(damaged, rows.select("conv_id").distinct())


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op3_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
            d AS (SELECT *, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first FROM p)
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
            FROM d""",
        "op11_conversation_repair": r"""
            WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
            h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda j: ascii(name[j])::BIGINT)),
                  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS k FROM t),
            d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                  unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE k <> 0),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
            g AS (SELECT *, left(role, 1) AS r, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM o),
            ins (a, b, put, lines) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', chr(10) || 'user:'), (1, 2, 'I', chr(10) || 'user:'), (3, 2, 'I', chr(10) || 'user:'), (2, 3, 'I', chr(10) || 'assistant:'),
                  (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
            ops (b, c, edit, first, word, price) AS (VALUES (0, 0, 'D', NULL, NULL, 4), (1, 1, 'D', NULL, NULL, 4), (2, 2, 'D', NULL, NULL, 4), (3, 3, 'D', NULL, NULL, 4),
                  (0, 2, 'R', NULL, 'user', 3), (1, 2, 'R', NULL, 'user', 3), (3, 2, 'R', NULL, 'user', 3), (2, 3, 'R', NULL, 'assistant', 3),
                  (0, 1, 'K', 's', NULL, 0), (0, 2, 'K', 'u', NULL, 0), (1, 2, 'K', 'u', NULL, 0), (3, 2, 'K', 'u', NULL, 0), (2, 3, 'K', 'a', NULL, 0)),
            w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, (0::BIGINT, '', '') AS best FROM g
              UNION ALL SELECT conv_id, i, s, min(way) FROM (
                SELECT w.conv_id, g.i, ops.c AS s, (w.best[1] + 3 * length(put) + price + CASE WHEN fault = 3 AND edit <> 'D' THEN 3 ELSE 0 END, w.best[2] || put || edit,
                       w.best[3] || lines || CASE edit WHEN 'D' THEN '' ELSE chr(10) || coalesce(word, role) || ':' || text END) AS way
                FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = w.i + 1 JOIN ins ON ins.a = w.s JOIN ops ON ops.b = ins.b AND (first IS NULL OR first = r) AND (edit = 'D' OR fault NOT IN (1, 2))) GROUP BY ALL),
            e AS (SELECT w.conv_id, min((best[1] + 3 * length(put), best[2] || put, best[3] || lines)) AS best FROM w JOIN ins ON ins.a = w.s AND ins.b IN (0, 3)
                  WHERE w.i = (SELECT max(i) FROM g WHERE g.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY w.conv_id),
            c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
                  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM g) GROUP BY conv_id)
            SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                   coalesce(best[1], 0) AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(best[3][2:], '')) AS repaired_sha256
            FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id""",
        "op12_decontaminate": r"""
            WITH t AS (SELECT doc_id, row_number() OVER () AS r,
                              regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            d AS (SELECT doc_id, r, coalesce(w, []) AS w FROM t),
            i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
            g AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
                  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
            o AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
                  FROM (SELECT d.*, l.n, unnest(range(1, len(w) - l.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) l WHERE len(w) >= l.n)),
            h AS (SELECT DISTINCT r, k, n, item FROM o JOIN g USING (n, win)),
            a AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r),
            b AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)""",
        "op13_hard_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
                       FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
            s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
                  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)),
            p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
            n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
                  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
            SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
        "op8_mixing": r"""
            WITH RECURSIVE d AS (
              SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                     md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
            s AS (SELECT source, sum(size)::DOUBLE AS source_size,
                         row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
            w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((r - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
            lv AS (SELECT a.*, (SELECT ((SELECT sum(source_size) FROM w) - coalesce(sum(b.cap), 0)) FROM w b
                                WHERE (b.cap / b.weight, b.r) < (a.cap / a.weight, a.r))
                             / (SELECT sum(b.weight) FROM w b WHERE (b.cap / b.weight, b.r) >= (a.cap / a.weight, a.r)) AS level FROM w a),
            t AS (SELECT *, least(cap, weight * (SELECT level FROM lv WHERE level * weight <= cap ORDER BY cap / weight, r LIMIT 1)) AS target FROM lv),
            q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                         ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            c AS (SELECT q.*, (upto + source_size * e.r) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS r) e WHERE size > 0),
            o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent FROM c WHERE finish <= 2),
            g AS (SELECT doc_id, source, k, upto, sum(size) AS taken FROM o WHERE spent <= (SELECT sum(size) FROM d) GROUP BY ALL)
            SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, round(q.target, 4) AS target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
            FROM q LEFT JOIN g ON q.doc_id = g.doc_id AND q.k = g.k AND q.upto = g.upto AND q.source IS NOT DISTINCT FROM g.source AND q.size > 0""",
    }
