"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.catalog.registry import query
from riskframe.llm import (
    chat, decontam, deleted_lm, lattice, lineblock, linerules, merkle, permuterm, ppm, ranking, ring, simhash, warc,
)
from riskframe.llm.text import id_crc, session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, 17 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS n FROM t),
o AS (
  SELECT *, 3 + sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], talk.schema
    )
    return chat.digest(chat.examples(chat.pack(talk.unionByName(probe))))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS l FROM w),
lj AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
    length(l) - length(regexp_replace(l, '[!?]', '', 'g')) AS marks,
    length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS syms FROM ln),
lv AS (SELECT doc_id, sum(length(l)) AS total, count(*) - count(DISTINCT l) AS dups, sum(CASE WHEN
    NOT regexp_matches(l, '[.!?:;\x{2026}"'')\]\x{201D}\x{2019}\x{00BB}][\x20\x09-\x0D]*$')
    OR 2 * marks > n OR 10 * syms > n OR regexp_matches(lower(l), '(^|[^a-z])(all rights reserved|copyright (\(c\) ?|\x{00A9} ?)?[12][0-9][0-9][0-9]|licensed under (a|the)|terms of (use|service)|privacy policy|(we|site|website|page) uses? cookies|(accept|allow|reject|manage) (all )?cookies|cookie (policy|settings|notice|consent|preferences)|enable javascript|javascript (is )?(disabled|required|turned off)|sign (in|up) (to|for|now|here)|log in (to|now|here|or)|subscribe (to our|now|today|here)|click here)([^a-z]|$)')
    THEN 0 ELSE length(l) END) AS kept_chars, sum(CASE WHEN
    NOT regexp_matches(l, '[.!?:;\x{2026}"'')\]\x{201D}\x{2019}\x{00BB}][\x20\x09-\x0D]*$')
    OR 2 * marks > n OR 10 * syms > n OR regexp_matches(lower(l), '(^|[^a-z])(all rights reserved|copyright (\(c\) ?|\x{00A9} ?)?[12][0-9][0-9][0-9]|licensed under (a|the)|terms of (use|service)|privacy policy|(we|site|website|page) uses? cookies|(accept|allow|reject|manage) (all )?cookies|cookie (policy|settings|notice|consent|preferences)|enable javascript|javascript (is )?(disabled|required|turned off)|sign (in|up) (to|for|now|here)|log in (to|now|here|or)|subscribe (to our|now|today|here)|click here)([^a-z]|$)')
    THEN 1 ELSE 0 END) AS bad FROM lj WHERE n > 0 GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(total, 0) AS total, coalesce(kept_chars, 0) AS kept_chars, CAST(coalesce(bad, 0) AS BIGINT) AS n_failed_lines
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lv USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= CAST(0.7 AS DOUBLE) * total AS kept,
  n_failed_lines
FROM b
"""


@query("op6_line_rules", OP6_SQL)
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.measure(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "n_failed_lines",
    )


OP10_SQL = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i
    FROM dw, (SELECT DISTINCT k FROM bs) WHERE len(ws) >= k)),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM p JOIN bn USING (item_id) WHERE 10 * n_shared >= 8 * n
"""


@query("op10_decontaminate", OP10_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def rank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose documents are not held out."""
    return table(spark, sf_dir, "labels").where(F.pmod(id_crc(), F.lit(5)) != 0)


@query("op1_bradley_terry")
def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ranking.vectors(table(spark, sf_dir, "documents"))
    model = ranking.fit_vectors(made, rank_labels(spark, sf_dir))
    scored = made.select(
        F.col("i").alias("doc_id"), (F.pmod(id_crc("i"), F.lit(5)) == 0).alias("held_out"),
        ranking.score_vector(F.col("x"), model).alias("score"),
    )
    return scored.select("*", (F.col("score") >= ranking.CUT).cast("int").alias("predicted"))


@query("op3_simhash_bktree")
def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_line_blocks")
def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineblock.extract(table(spark, sf_dir, "pages"))


@query("op7_bounded_ring")
def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.place_rows(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_warc_salvage")
def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.resolve(records)


@query("op4_deleted_interpolation")
def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(id_crc(), F.lit(7)) == 2
    scored = deleted_lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op8_nbest_pieces")
def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all N segmentations are built, not only their scores."""
    return lattice.digest(lattice.encode(table(spark, sf_dir, "documents"), all_ids=True))


@query("op11_ppm_language")
def op11_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc(), F.lit(4)) == 2
    model = ppm.fit(docs.where(~held_out))
    guess = docs.select("doc_id", held_out.alias("held_out"), ppm.predict(F.col("text"), model).alias("guess"))
    return guess.select("doc_id", "held_out", "guess.lang_pred", "guess.score")


OP12_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda b: CAST(ord(b) AS BIGINT))), lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS k FROM documents),
t AS (SELECT doc_id, lang, source, text, n_chars,
    CASE WHEN xor(k, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m_chars FROM c),
f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z FROM t),
leaf AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS h,
    sha256(a || coalesce(strlen(CAST(m_chars AS VARCHAR)) || ':' || m_chars, '-') || z) AS th FROM f),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
placed AS (SELECT doc_id, g, h, th, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
    count(*) OVER (PARTITION BY g) AS n FROM leaf JOIN langs ON leaf.lang IS NOT DISTINCT FROM langs.lang),
low(g, lvl, i, n, h) AS (SELECT g, 0, i, n, h FROM placed
  UNION ALL SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, lvl, n, i // 2),
sub AS (SELECT g, h, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, i, n, h) AS (SELECT 0, g, n, h FROM sub
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, n, i // 2),
steps AS (
  SELECT placed.doc_id, placed.h, lvl, low.h AS s, low.i % 2 = 0 AS on_left
  FROM placed JOIN low ON low.g = placed.g AND xor(low.i, 1) = placed.i // (1 << lvl) AND low.n > 1
  UNION ALL SELECT placed.doc_id, placed.h, 100 + lvl, high.h, high.i % 2 = 0
  FROM placed JOIN high ON xor(high.i, 1) = placed.g // (1 << lvl) AND high.n > 1),
proof AS (SELECT doc_id, sha256(string_agg(s, '' ORDER BY lvl)) AS d FROM steps GROUP BY doc_id),
levels AS (SELECT g, lvl FROM low WHERE n > 1 GROUP BY g, lvl UNION ALL SELECT g, 100 + lvl FROM langs, high WHERE n > 1 GROUP BY g, lvl),
numbered AS (SELECT g, lvl, row_number() OVER (PARTITION BY g ORDER BY lvl) - 1 AS k FROM levels),
walk AS (SELECT placed.doc_id, k, s, on_left FROM placed JOIN numbered USING (g) LEFT JOIN steps ON steps.doc_id = placed.doc_id AND steps.lvl = numbered.lvl),
folded(doc_id, k, h) AS (SELECT doc_id, CAST(0 AS BIGINT), th FROM placed
  UNION ALL SELECT folded.doc_id, folded.k + 1, sha256(CASE WHEN s IS NULL THEN h WHEN on_left THEN s || h ELSE h || s END)
  FROM folded JOIN walk USING (doc_id, k)),
last AS (SELECT doc_id, max_by(h, k) AS r FROM folded GROUP BY doc_id)
SELECT placed.doc_id, placed.h AS leaf, sub.h AS subroot, root.h AS root, coalesce(d, sha256('')) AS proof_sha256,
  r AS folded_root, r = root.h AS verified
FROM placed JOIN sub USING (g) JOIN (SELECT h FROM high WHERE n = 1) AS root ON true
JOIN last USING (doc_id) LEFT JOIN proof USING (doc_id)
"""


@query("op12_merkle_multiproof", OP12_SQL)
def op12_merkle_multiproof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.tampered())


OP13_SQL = r"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
lowered AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM runs WHERE length(r) >= 7 GROUP BY ALL),
hexed AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM lowered),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2),
    lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
    lambda c, d: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) AS h FROM hexed),
slipped AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM gaps a JOIN v ON v.word = a.g
  UNION SELECT v.word, a.word, a.n FROM gaps a JOIN v ON v.word = a.g),
best AS (SELECT word, count(*) AS n_near, max(n) AS m FROM near GROUP BY word),
named AS (SELECT best.word, n_near, m, min(other) AS f FROM best JOIN near ON near.word = best.word AND near.n = best.m GROUP BY ALL),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN f END AS form,
    CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN named USING (word)),
chain AS (SELECT a.word, coalesce(d.form, c.form, b.form, a.form, a.word) AS root FROM forms a
  LEFT JOIN forms b ON b.word = a.form LEFT JOIN forms c ON c.word = b.form LEFT JOIN forms d ON d.word = c.form)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""


@query("op13_permuterm_variants", OP13_SQL)
def op13_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.variants(table(spark, sf_dir, "documents"))
