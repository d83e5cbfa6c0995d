"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embedding_dedup, hmm_lm, minhash, mixing, quality, resharding, sentencepieces, simhash, suffix_dedup
from .common import shared_dir, table

#: Target weights of the mixing query; a source without one weighs 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/cw-shards-{uuid.uuid4().hex}")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_documents(table(spark, sf_dir, "documents"), simhash.NEAR_RADIUS, simhash.NEAR_BLOCKS)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode(docs, intact="intact").select("doc_id", "tokens", "intact")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where("accepted").select("doc_id", "p_clean", "p_low", "p_toxic")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm_lm.score(docs, hmm_lm.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_suffix_dedup, op2_chat_format, op3_reshard, op4_simhash, op5_mix_sources, op6_sentencepiece, op7_minhash_dedup, op8_quality_classifier, op9_embedding_dedup, op10_hmm_score)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": r"""
            WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x00-\x20]+') AS ws FROM documents WHERE text IS NOT NULL),
            n AS (SELECT r, doc_id, unnest(range(len(ws) - 49)) AS i, ws FROM w WHERE len(ws) >= 50),
            h AS (SELECT r, doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM n),
            c AS (SELECT r, doc_id, i, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM h),
            f AS (SELECT r, doc_id, i, false AS repeat FROM c WHERE n > 1 UNION ALL SELECT r, doc_id, i, true FROM c WHERE rn > 1),
            g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r, repeat ORDER BY i) <= 50 THEN 0 ELSE 1 END AS b FROM f),
            k AS (SELECT *, sum(b) OVER (PARTITION BY r, repeat ORDER BY i) AS g FROM g)
            SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, repeat FROM k GROUP BY r, doc_id, repeat, g""",
        "op2_chat_format": r"""
            WITH p AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS pr, lag(turn) OVER w AS pt,
                       max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ub
                       FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            c AS (SELECT conv_id, turn, 'call-' || turn AS id, ub, text FROM p WHERE role = 'user'),
            a AS (SELECT conv_id, turn, CASE WHEN pr = 'user' THEN 'call-' || pt ELSE 'none-' || turn END AS id, text FROM p WHERE role = 'assistant'),
            j AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.id, a.id) AS id, c.turn AS ct, a.turn AS rt, c.ub, c.text AS q, a.text AS x
                  FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.id = a.id),
            s AS (SELECT conv_id, min_by(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
            o AS (SELECT conv_id, count(ct) AS n_calls, count(CASE WHEN ct IS NOT NULL THEN rt END) AS n_linked,
                  count(CASE WHEN ct IS NOT NULL AND length(q) > 0 THEN 1 END) AS n_valid, count(*) - count(ct) AS n_orphans,
                  coalesce(string_agg('{"arguments":{' || CASE WHEN ub IS NOT NULL THEN '"after":"$call-' || ub || '",' ELSE '' END || '"prompt":' || to_json(q)::VARCHAR || '}'
                    || CASE WHEN length(q) = 0 THEN ',"errors":["$.prompt: too short"]' ELSE '' END
                    || ',"id":"' || id || '","name":"reply","result":' || CASE WHEN rt IS NULL THEN 'null' ELSE to_json(x)::VARCHAR END
                    || ',"status":"' || CASE WHEN rt IS NULL THEN 'unanswered' ELSE 'linked' END || '","valid":' || CASE WHEN length(q) > 0 THEN 'true' ELSE 'false' END || '}', ',' ORDER BY ct)
                    FILTER (ct IS NOT NULL), '') AS calls,
                  coalesce(string_agg('{"id":"' || id || '","result":' || to_json(x)::VARCHAR || '}', ',' ORDER BY rt) FILTER (ct IS NULL), '') AS orphans
                  FROM j GROUP BY conv_id)
            SELECT o.conv_id, n_calls, n_linked, n_valid, n_orphans,
                   '{"calls":[' || calls || '],"conv_id":' || o.conv_id || ',"orphans":[' || orphans || '],"system":' || coalesce(to_json(s.system)::VARCHAR, 'null') || '}' AS chat
            FROM o LEFT JOIN s ON o.conv_id = s.conv_id""",
        "op3_reshard": r"""
            WITH d AS (SELECT doc_id, coalesce(source, '') AS shard, coalesce(strlen(text), 0) AS bytes, floor(coalesce(doc_id, -1) / 1024)::BIGINT AS block FROM documents),
            b AS (SELECT shard, block, sum(bytes)::BIGINT AS bytes FROM d GROUP BY ALL),
            o AS (SELECT shard, sum(bytes)::BIGINT AS size FROM b GROUP BY shard),
            m AS (SELECT shard FROM o UNION ALL SELECT 'new' || i FROM range(4) t(i)),
            q AS (SELECT ((SELECT sum(size) FROM o) + (SELECT count(*) FROM m) - 1)::BIGINT // (SELECT count(*) FROM m) AS cap),
            g AS (SELECT m.shard, coalesce(size, 0) AS size, least(coalesce(size, 0), cap) AS stay, greatest(coalesce(size, 0) - cap, 0) AS over, cap - least(coalesce(size, 0), cap) AS room FROM m LEFT JOIN o USING (shard), q),
            e AS (SELECT *, sum(over) OVER (ORDER BY shard) - over AS o0, sum(room) OVER (ORDER BY shard) - room AS r0 FROM g),
            t AS (SELECT x.shard, y.shard AS goal, x.stay + greatest(o0_, y.r0) - o0_ AS lo, x.stay + least(o0_ + x.over, y.r0 + y.room) - o0_ AS hi
                  FROM (SELECT *, o0 AS o0_ FROM e) x JOIN e y ON x.over > 0 AND y.room > 0 AND o0_ < y.r0 + y.room AND y.r0 < o0_ + x.over
                  UNION ALL SELECT shard, shard, 0, stay FROM e WHERE stay > 0 OR (stay = 0 AND over = 0 AND size = 0)),
            l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY lo DESC, hi DESC) = 1 THEN 4611686018427387904 ELSE hi END AS hi2 FROM t),
            p AS (SELECT shard, block, sum(bytes) OVER (PARTITION BY shard ORDER BY block) - bytes AS at FROM b)
            SELECT d.doc_id, d.shard AS old_shard, l.goal AS new_shard, d.shard <> l.goal AS moved
            FROM d JOIN p USING (shard, block) JOIN l ON l.shard = d.shard AND p.at >= l.lo AND p.at < l.hi2""",
        "op5_mix_sources": r"""
            WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0)::BIGINT AS tokens, md5('5:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
            c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id, tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d),
            f AS (SELECT doc_id, source, tokens, cum / CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 3.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS finish FROM c),
            r AS (SELECT *, sum(tokens) OVER (ORDER BY finish, source NULLS FIRST, doc_id, tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM f)
            SELECT doc_id, source, tokens, finish, running FROM r WHERE running <= (SELECT floor(sum(tokens) * 0.5) FROM d)""",
        "op7_minhash_dedup": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x20]+') AS ws FROM documents),
            t AS (SELECT doc_id, CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(len(ws) - 2), lambda i: array_to_string(ws[i + 1:i + 3], ' ')) END AS g FROM w WHERE len(ws) > 0),
            s AS (SELECT DISTINCT doc_id, unnest(g) AS g FROM t), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.5 * (x.n + y.n - c)),
            u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
            r AS (SELECT a AS doc_id, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a WHERE r.root < u.b)
            SELECT doc_id, min(root) AS group_id, doc_id = min(root) AS kept FROM r GROUP BY doc_id""",
        "op9_embedding_dedup": r"""
            WITH c AS (SELECT embedding, min(vec_id) AS class_id, count(DISTINCT vec_id) AS n_same FROM embeddings GROUP BY embedding),
            l AS (SELECT a.embedding, count(*) AS n FROM c a JOIN c b ON a.embedding <> b.embedding
                  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95 GROUP BY a.embedding)
            SELECT DISTINCT e.vec_id, c.class_id, c.n_same, coalesce(l.n, 0) AS n_links
            FROM embeddings e JOIN c ON e.embedding = c.embedding LEFT JOIN l ON l.embedding = c.embedding""",
    }
