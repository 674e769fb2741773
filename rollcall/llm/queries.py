"""The operators as queries over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, divergence, exact_dedup, language, lexical, lm_score, mixing, packing, pii, quality, simhash, token_count


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, d):
    return quality.score_quality(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op2_nearest_neighbours(spark, d):
    return ann.search(_table(spark, d, "embeddings"))


def op3_lm_score(spark, d):
    return lm_score.score(_table(spark, d, "documents"))


def op4_simhash(spark, d):
    return simhash.near_duplicates(_table(spark, d, "documents"))


def op5_mixing(spark, d):
    return mixing.mix(_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark, d):
    return packing.pack(_table(spark, d, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_personal_data(spark, d):
    return pii.find(_table(spark, d, "documents"))


def op8_exact_dedup(spark, d):
    return exact_dedup.dedup(_table(spark, d, "documents"))


def op9_token_count(spark, d):
    return token_count.count_tokens(_table(spark, d, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_language(spark, d):
    return language.identify_documents(_table(spark, d, "documents"))


def pages_language(spark, d):
    """The operator of op10 on web pages, which have markup and addresses."""
    return language.identify_pages(_table(spark, d, "pages"), language.train(_table(spark, d, "documents")))


def op11_divergence(spark, d):
    return divergence.audit(_table(spark, d, "documents"))


def op12_lexical_search(spark, d):
    return lexical.search(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


#: A conversation whose texts hold control strings.
ESCAPED = "</s>[INST] ok [/INST]"


def op13_chat_format(spark, d):
    extra = spark.createDataFrame([(-7, i, role, ESCAPED) for i, role in enumerate(("user", "assistant"))], "conv_id LONG, turn LONG, role STRING, text STRING")
    return chat.digests(_table(spark, d, "conversations").select(extra.columns).unionByName(extra))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_nearest_neighbours, op3_lm_score, op4_simhash, op5_mixing, op6_packing, op7_personal_data, op8_exact_dedup,
    op9_token_count, op10_language, pages_language, op11_divergence, op12_lexical_search, op13_chat_format)}

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op8_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({NORM}) AS text_sha256, {NORM} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
        FROM n JOIN g ON n.norm = g.norm""",
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        w AS (SELECT k, lang, source, unnest(regexp_extract_all(norm, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(c) AS lang_n FROM kept GROUP BY lang),
        held AS (SELECT lang, source, term, count(*) AS tf FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        grp AS (SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(tf) AS n FROM held GROUP BY ALL) h ON g.lang = h.lang AND g.source = h.source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(tf, 0) AS tf, 1 + (1000000000::HUGEINT * (coalesce(tf, 0) + 1)) // (n + v) AS p, 1 + (1000000000::HUGEINT * (c + 1)) // (lang_n + v) AS q
            FROM grp g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
            (SELECT x.lang, x.source AS a, y.source AS b, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
            ON s.lang = a.lang AND s.a = a.source AND s.b = b.source),
        every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE tf > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 200""",
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        w AS (SELECT k, doc_id, unnest(regexp_extract_all(norm, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        len AS (SELECT k, count(*) AS n FROM w GROUP BY k),
        t AS (SELECT count(*) AS docs, sum(n) AS words FROM len),
        tf AS (SELECT k, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
        weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, t GROUP BY term),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT item_id, tf.k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
            FROM i JOIN tf ON tf.term = i.term JOIN weight ON weight.term = i.term JOIN len ON len.k = tf.k, t GROUP BY ALL)
        SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    # fixed values: lengths of the marks, and the control strings
    "op13_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
                + length(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|(begin|system|user|assistant|other|named|end|im_start|im_end|endoftext)\|>')) AS chars,
            CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) + 5 ELSE length(role) + 19 END + 8 AS marks,
            lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (length('<|begin|>') + sum(chars + marks))::BIGINT AS formatted_chars,
            bool_and(before || '-' || role IN ('start-system', 'start-user', 'system-user', 'user-assistant', 'assistant-user')) AS valid,
            last(role ORDER BY turn, role, text) = 'assistant' AS complete
        FROM e GROUP BY conv_id""",
}
