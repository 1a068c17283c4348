"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import chat, html_region, language_model, line_crf, media, mixing, packing, ranked_search, rules, sharding, simhash, token_counts, turn_repair
from tapewatch.llm.common import table, written


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = media.render_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return media.copy_classes(drawn, "vec_id", "image")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


OP4_SQL = """
WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY 1),
r AS (SELECT source, CAST((SELECT sum(c) FROM n) AS DOUBLE) * sqrt(c) / ((SELECT sum(sqrt(c)) FROM n) * c) AS rate FROM n),
k AS (SELECT unnest(range(0, 120)) AS k),
f AS (SELECT k, coalesce(sum(CASE WHEN k > 0 THEN ln(k) END) OVER (ORDER BY k), 0) AS lf FROM k),
p AS (SELECT r.source, r.rate, f.k, sum(exp(f.k * ln(r.rate) - r.rate - f.lf)) OVER (PARTITION BY r.source ORDER BY f.k) AS cdf FROM r, f),
u AS (SELECT *, CAST('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR) || '|' || source), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM documents)
SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, p.k + 1 AS copy_no,
  CAST('0x' || substr(md5('mix|' || CAST(u.doc_id AS VARCHAR) || '|' || CAST(p.k + 1 AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key, round(p.rate, 9) AS rate
FROM u JOIN p ON p.source = u.source AND p.cdf <= u.u"""


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_region.extract_pages(pages, html_region.fit_weights(pages))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.fold_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    trees = chat.turn_trees(rows.unionByName(extra))
    back = chat.read_back(chat.format_reply_trees(trees))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
told AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id"""


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS g0, coalesce(source, '') AS g1, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    regexp_extract_all(coalesce(text, ''), '[^\n]*[^\x20\x09-\x0D][^\n]*') AS lines FROM documents),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, g0, g1, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered ON covered.rid = d.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (
  SELECT g0, g1, 'symbols' AS measure, n_symbols * 1000000 // greatest(word_chars, 1) AS v FROM b WHERE NOT base_failed
  UNION ALL SELECT g0, g1, 'dup_lines', n_dup_lines * 1000000 // greatest(n_lines, 1) FROM b WHERE NOT base_failed
  UNION ALL SELECT g0, g1, 'word_length', word_chars * 1000 // greatest(n_words, 1) FROM b WHERE NOT base_failed),
s AS (SELECT *, (v >> greatest(length(bin(v)) - 9, 0)) << greatest(length(bin(v)) - 9, 0) AS bucket FROM v),
levels AS (SELECT 2 AS level, g0, g1, measure, bucket FROM s UNION ALL SELECT 1, g0, '', measure, bucket FROM s UNION ALL SELECT 0, '', '', measure, bucket FROM s),
h AS (SELECT level, g0, g1, measure, bucket, count(*) AS n FROM levels GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, g0, g1, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, g0, g1, measure) AS all_n FROM h),
q AS (SELECT level, g0, g1, measure, min(bucket) FILTER (upto * 4 >= all_n) AS q1, min(bucket) FILTER (upto * 4 >= all_n * 3) AS q3 FROM r GROUP BY ALL),
t AS (
  SELECT level, g0, g1, measure, bucket, n, upto, all_n, q3 + 3.0 * (q3 - q1) AS top, q1 - 3.0 * (q3 - q1) AS bottom,
    coalesce(sum(n) FILTER (bucket > q3 + 3.0 * (q3 - q1)) OVER w, 0) AS above, coalesce(sum(n) FILTER (bucket < q1 - 3.0 * (q3 - q1)) OVER w, 0) AS below
  FROM r JOIN q USING (level, g0, g1, measure) WINDOW w AS (PARTITION BY level, g0, g1, measure)),
u AS (
  SELECT level, g0, g1, measure, CAST(max(all_n) AS DOUBLE) AS k, CAST(max(top) AS DOUBLE) AS top, CAST(max(bottom) AS DOUBLE) AS bottom,
    min(bucket) FILTER (bucket > top AND (upto - all_n + above) * 10 >= above) AS nearest_above,
    max(bucket) FILTER (bucket < bottom AND (below - upto + n) * 10 >= below) AS nearest_below FROM t GROUP BY ALL),
e AS (SELECT *, top + coalesce(nearest_above - top, 0) * 0.25 AS high, bottom + coalesce(nearest_below - bottom, 0) * 0.25 AS low FROM u),
f AS (
  SELECT a.g0, a.measure, (a.k * a.high + 20.0 * z.high) / (a.k + 20.0) AS high, (a.k * a.low + 20.0 * z.low) / (a.k + 20.0) AS low
  FROM e a JOIN e z ON a.level = 1 AND z.level = 0 AND a.measure = z.measure),
o AS (
  SELECT a.g0, a.g1, a.measure, (a.k * a.high + 20.0 * f.high) / (a.k + 20.0) AS high, (a.k * a.low + 20.0 * f.low) / (a.k + 20.0) AS low
  FROM e a JOIN f ON a.level = 2 AND a.g0 = f.g0 AND a.measure = f.measure),
l AS (
  SELECT g0, g1, max(high) FILTER (measure = 'symbols') AS sh, max(high) FILTER (measure = 'dup_lines') AS dh,
    max(high) FILTER (measure = 'word_length') AS wh, greatest(max(low) FILTER (measure = 'word_length'), 0.0) AS wl FROM o GROUP BY ALL),
x AS (SELECT b.*, sh * word_chars / 1e6 AS xs, dh * n_lines / 1e6 AS xd, wh * n_words / 1e3 AS xh, wl * n_words / 1e3 AS xl FROM b LEFT JOIN l ON b.g0 = l.g0 AND b.g1 = l.g1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(n_symbols <= xs + 4 * sqrt(xs + 1) AND n_dup_lines <= xd + 4 * sqrt(xd + 1)
    AND word_chars <= xh + 4 * sqrt(xh + 1) AND word_chars >= xl - 4 * sqrt(xl + 1), true) AS kept
FROM x"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents", "doc_id", "text"), F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.place(rows, then=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 of the hex digits h, byte by byte through the table t made from its polynomial.
CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"
OP11_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, s, -ln((CAST('0x' || substr(md5('shard|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(s AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) AS wait
  FROM d, (SELECT unnest(range(17)) AS s)),
g AS (SELECT rid, arg_min(s, (wait, s)) FILTER (s < 16) AS shard, arg_min(s, (wait, s)) AS grown FROM w GROUP BY 1),
r AS (SELECT doc_id, CAST(strlen(h) // 2 + 1 AS BIGINT) AS size, CAST({CRC} AS BIGINT) AS text_crc32, shard, grown FROM d JOIN g ON d.rid = g.rid, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM r"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written(ranked_search.build_index(table(spark, sf_dir, "documents", "doc_id", "text")))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark", "item_id", "text"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
k AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, k),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(terms) * n_all) // greatest(l_all, 1) AS m FROM d, k),
s AS (SELECT q.item_id, m.rid, m.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN w ON q.term = w.term JOIN p ON q.term = p.term JOIN m ON p.rid = m.rid GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50"""


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damaged_and_repaired(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: States of the repair are the best audits and lines from a row on, for nothing yet (s0), after s (s1), u (s2) and a (s3); the key is cost, then audit.
OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {CRC} % 20 AS kind FROM src, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
pos AS (SELECT *, row_number() OVER w AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role[1:1]) OVER w AS before FROM dmg WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
row_ AS (SELECT *, role[1:1] AS ini, CASE WHEN cut = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN cut[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM pos),
cnt AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY 1),
dp AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS s1, {{'c': 5, 'a': 'I', 't': ['assistant:']}} AS s2, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s3 FROM cnt
  UNION ALL
  SELECT conv_id, i, list_min([b0, {{'c': v2.c + 5, 'a': 'I' || v2.a, 't': list_prepend('user:', v2.t)}}]), list_min([b1, {{'c': v2.c + 5, 'a': 'I' || v2.a, 't': list_prepend('user:', v2.t)}}]), v2, v3 FROM (
    SELECT *, list_min([b2, {{'c': b3.c + 5, 'a': 'I' || b3.a, 't': list_prepend('assistant:', b3.t)}}]) AS v2, list_min([b3, {{'c': b2.c + 5, 'a': 'I' || b2.a, 't': list_prepend('user:', b2.t)}}]) AS v3 FROM (
      SELECT dp.conv_id, dp.i - 1 AS i,
        list_min([{{'c': s0.c + 2, 'a': 'D' || s0.a, 't': s0.t}}, CASE WHEN stay AND ini = 's' THEN {{'c': s1.c + x, 'a': 'K' || s1.a, 't': list_prepend(own, s1.t)}} END, CASE WHEN stay AND ini = 'u' THEN {{'c': s2.c + x, 'a': 'K' || s2.a, 't': list_prepend(own, s2.t)}} END, CASE WHEN stay THEN {{'c': s2.c + x + 1, 'a': 'R' || s2.a, 't': list_prepend(usr, s2.t)}} END]) AS b0,
        list_min([{{'c': s1.c + 2, 'a': 'D' || s1.a, 't': s1.t}}, CASE WHEN stay AND ini = 'u' THEN {{'c': s2.c + x, 'a': 'K' || s2.a, 't': list_prepend(own, s2.t)}} END, CASE WHEN stay THEN {{'c': s2.c + x + 1, 'a': 'R' || s2.a, 't': list_prepend(usr, s2.t)}} END]) AS b1,
        list_min([{{'c': s2.c + 2, 'a': 'D' || s2.a, 't': s2.t}}, CASE WHEN stay AND ini = 'a' THEN {{'c': s3.c + x, 'a': 'K' || s3.a, 't': list_prepend(own, s3.t)}} END, CASE WHEN stay THEN {{'c': s3.c + x + 1, 'a': 'R' || s3.a, 't': list_prepend(ast, s3.t)}} END]) AS b2,
        list_min([{{'c': s3.c + 2, 'a': 'D' || s3.a, 't': s3.t}}, CASE WHEN stay AND ini = 'u' THEN {{'c': s2.c + x, 'a': 'K' || s2.a, 't': list_prepend(own, s2.t)}} END, CASE WHEN stay THEN {{'c': s2.c + x + 1, 'a': 'R' || s2.a, 't': list_prepend(usr, s2.t)}} END]) AS b3
      FROM dp JOIN (SELECT conv_id, i, ini, fault NOT IN ('blank', 'duplicate') AS stay, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x, role || ':' || text AS own, 'user:' || text AS usr, 'assistant:' || text AS ast FROM row_) r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM o.conv_id AND dp.i = 0"""


QUERIES = {
    "op1_media": op1_media,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_html": op6_html,
    "op7_rules": op7_rules,
    "op8_packing": op8_packing,
    "op9_language_model": op9_language_model,
    "op10_token_counts": op10_token_counts,
    "op11_sharding": op11_sharding,
    "op12_ranked_search": op12_ranked_search,
    "op13_turn_repair": op13_turn_repair,
}
ORACLE = {"op4_mixing": OP4_SQL, "op5_chat": OP5_SQL, "op7_rules": OP7_SQL, "op11_sharding": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_turn_repair": OP13_SQL}
