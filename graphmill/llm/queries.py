"""The operators with production parameters over their whole tables, as the driver's queries, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe, chat
from graphmill.llm.collocations import mine_phrases
from graphmill.llm.common import map_rows
from graphmill.llm.embed_dedup import similar_vectors
from graphmill.llm.exact_dedup import exact_dedup
from graphmill.llm.langid import identify
from graphmill.llm.nearest import nearest
from graphmill.llm.ngram_lm import score_texts
from graphmill.llm.packing import pack
from graphmill.llm.pii import KINDS, find_pii
from graphmill.llm.simhash import simhash_dedup
from graphmill.llm.turns import damage, repair_conversations, with_lost
from graphmill.llm.warc import archived_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        code = bpe.codec(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                ids = code.encode(text.as_py() or "")
                found.append((len(ids), sha(",".join(map(code.decimal.__getitem__, ids))), sha(code.decode(ids))))
            yield {"doc_id": batch.column("doc_id")} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), map(list, zip(*found)) if found else ([], [], []), strict=True))

    return map_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


#: A conversation whose texts are control strings of the template.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    shown = chat.format_chats(turns.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")), append_only=True)

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv_id, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
                turns = chat.parse_inst(formatted)
                loss = "".join(chat.unescape(formatted[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                for k, v in zip(out, (conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                    out[k].append(v)
            yield out

    return map_rows(shown, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", read_back)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine_phrases(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return with_lost(repair_conversations(damage(turns, parts=20)), turns)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), keep=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_embed_dedup": op2_embed_dedup,
    "op3_bpe": op3_bpe,
    "op4_lm_score": op4_lm_score,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_pii": op7_pii,
    "op8_chat_format": op8_chat_format,
    "op9_pack": op9_pack,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_turns": op12_turns,
    "op13_nearest": op13_nearest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embed_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (
            SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
            WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
        r AS (SELECT vec_id AS id, vec_id AS seen FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
        c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
        d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.id = v.vec_id LEFT JOIN d ON d.a = v.vec_id""",
    "op5_exact_dedup": """
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op8_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        g AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   sum(20 + length(role) + length(text)
                       + len(regexp_extract_all(role, '[<\[]/?\\*(s>|INST\])')) + len(regexp_extract_all(text, '[<\[]/?\\*(s>|INST\])'))) AS chars
            FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""",
    "op11_collocations": r"""
        WITH t AS (
            SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT i, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        k AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        g AS (
            SELECT lang, 1 AS k, w[i] AS phrase, count(*) AS f FROM k GROUP BY ALL
            UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1], count(*) FROM k WHERE i < len(w) GROUP BY ALL
            UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], count(*) FROM k WHERE i + 1 < len(w) GROUP BY ALL),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
        s AS (
            SELECT c.*, j.j, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM c, (VALUES (1), (2)) j(j), g x, g y
            WHERE j.j < c.k AND x.lang = c.lang AND y.lang = c.lang AND x.k = j.j AND y.k = c.k - j.j
              AND x.phrase = array_to_string(w[1:j.j], ' ') AND y.phrase = array_to_string(w[j.j + 1:], ' ')),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM s),
        o AS (
            SELECT lang, phrase, max(f) AS over FROM (
                SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS f FROM c WHERE k = 3
                UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
        r AS (
            SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
            FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase AND b.k = 2
            WHERE cut = 1 AND (o.over IS NULL OR 100 * o.over < 50 * a))
        SELECT r.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000""",
    "op12_turns": r"""
        WITH RECURSIVE s AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295::BIGINT), 4294967295) % 20 AS kind
            FROM conversations),
        d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM s, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        f AS (
            SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
            FROM o),
        c AS (
            SELECT conv_id, n AS i, n, 0::BIGINT AS c0, 6::BIGINT AS c1, 3::BIGINT AS c2, 0::BIGINT AS c3, 0::BIGINT AS m, 0::BIGINT AS d0 FROM f GROUP BY conv_id, n
            UNION ALL
            SELECT conv_id, i - 1, n, least(b0, 3 + u), least(b1, 3 + u), u, least(b3, 3 + b2), m, 0 FROM (
                SELECT *, least(b2, 3 + b3) AS u FROM (
                    SELECT c.conv_id, c.i, c.n, CASE WHEN f.fault = 't' THEN 3 ELSE 0 END AS m,
                           least(4 + c0, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE CASE WHEN r = 's' THEN least(c1, 3 + c2) WHEN r = 'u' THEN c2 ELSE 3 + c2 END + CASE WHEN f.fault = 't' THEN 3 ELSE 0 END END) AS b0,
                           least(4 + c1, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE CASE WHEN r = 'u' THEN c2 ELSE 3 + c2 END + CASE WHEN f.fault = 't' THEN 3 ELSE 0 END END) AS b1,
                           least(4 + c2, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE CASE WHEN r = 'a' THEN c3 ELSE 3 + c3 END + CASE WHEN f.fault = 't' THEN 3 ELSE 0 END END) AS b2,
                           least(4 + c3, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 ELSE CASE WHEN r = 'u' THEN c2 ELSE 3 + c2 END + CASE WHEN f.fault = 't' THEN 3 ELSE 0 END END) AS b3
                    FROM c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i))),
        g AS (SELECT conv_id, i, n, [c0, c1, c2, c3] AS c FROM c),
        w AS (
            SELECT conv_id, 0::BIGINT AS i, n, 0 AS q, '' AS audit, []::VARCHAR[] AS said, false AS done FROM g WHERE i = 0
            UNION ALL
            SELECT conv_id, CASE WHEN e IN ('I', 'E') THEN i ELSE i + 1 END, n,
                   CASE e WHEN 'D' THEN q WHEN 'E' THEN q WHEN 'K' THEN CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE x END,
                   CASE WHEN e = 'E' THEN audit ELSE audit || e END,
                   CASE e WHEN 'D' THEN said WHEN 'E' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
                          WHEN 'I' THEN list_append(said, CASE x WHEN 2 THEN 'user:' ELSE 'assistant:' END) ELSE list_append(said, CASE x WHEN 2 THEN 'user:' ELSE 'assistant:' END || text) END, e = 'E'
            FROM (
                SELECT w.conv_id, w.i, w.n, w.q, w.audit, w.said, f.r, f.role, f.text, z.x,
                       CASE WHEN w.i < w.n AND 4 + h.c[w.q + 1] = g.c[w.q + 1] THEN 'D'
                            WHEN w.i = w.n AND w.q IN (0, 3) THEN 'E'
                            WHEN 3 + g.c[z.x + 1] = g.c[w.q + 1] THEN 'I'
                            WHEN (f.r = 's' AND w.q = 0 AND h.c[2] + CASE WHEN f.fault = 't' THEN 3 ELSE 0 END = g.c[w.q + 1])
                              OR (f.r = CASE z.x WHEN 2 THEN 'u' ELSE 'a' END AND h.c[z.x + 1] + CASE WHEN f.fault = 't' THEN 3 ELSE 0 END = g.c[w.q + 1]) THEN 'K'
                            ELSE 'R' END AS e
                FROM w JOIN (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) z(q, x) ON z.q = w.q
                JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i
                LEFT JOIN g h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i + 1
                LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
                WHERE NOT w.done)),
        t AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
                   count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(g.c[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a
        LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.done
        LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id AND g.i = 0""",
}
