"""The registered queries of the corpus operators: one opN_<name> an operator, thin over the operator's own interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casegraph.llm import chosen_path, conversation, fingerprint, language, lattice_lm, line_dedup, media, mixing, packing, quality, sharding, two_fit, whitening


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_docs(spark, sf_dir), min_docs=10, min_chars=1)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(_docs(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir), block_rows=64, period=1024, temper=0.5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(_docs(spark, sf_dir), shards=40)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), size=1024, open_windows=64)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_docs(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(_docs(spark, sf_dir), per_language=400)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_scores(_docs(spark, sf_dir))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_docs(spark, sf_dir), words=5, threshold=0.8)


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit.pack(_docs(spark, sf_dir), size=2048)


def op12_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_media, op2_line_dedup, op3_quality, op4_language, op5_sharding, op6_chosen_path, op7_lattice_lm, op8_packing, op9_fingerprint, op10_mixing, op11_best_two_fit, op12_conversation, op13_whitening]
    return {q.__name__: q for q in every}


OP2_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""


_LANES = [f"{w}{k}" for w in "ab" for k in range(60)]
OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT doc_id, n, text, nt, left(text, n - n // 2) || left(nt, n // 2) AS edited FROM o),
t AS (SELECT doc_id, 'f' AS kind, text FROM e UNION ALL SELECT doc_id, 'e', edited FROM e UNION ALL SELECT doc_id, 'n', nt FROM e),
u AS (SELECT doc_id, kind, unnest(list_filter(string_split_regex(text, '\\n|[.!?] '), lambda x: x <> '')) AS p FROM t),
w AS (SELECT doc_id, kind, CAST('0x' || substr(md5(p), 1, 15) AS BIGINT) AS a, CAST('0x' || substr(md5(p), 16, 15) AS BIGINT) AS b FROM u),
s AS (SELECT t.doc_id, t.kind, count(a) AS c, CAST(coalesce(sum(a), 0) % 1152921504606846976 AS BIGINT) AS sa, CAST(coalesce(sum(b), 0) % 1152921504606846976 AS BIGINT) AS sb, {sums}
      FROM (SELECT doc_id, kind FROM t) t LEFT JOIN w ON w.doc_id = t.doc_id AND w.kind = t.kind GROUP BY 1, 2),
v AS (SELECT doc_id, kind, c, sa, sb, [{bits}] AS bits FROM s),
l AS (SELECT doc_id, kind, format('{{:016x}}', c) || format('{{:016x}}', sa) || format('{{:016x}}', sb)
        || array_to_string(list_transform(range(40), lambda i: format('{{:016x}}', CAST(bits[(i // 20) * 60 + i % 20 + 1] + bits[(i // 20) * 60 + i % 20 + 21] * 1048576 + bits[(i // 20) * 60 + i % 20 + 41] * 1099511627776 AS BIGINT))), '') AS fp,
        list_transform(bits, lambda x: ((2 * x - c + 262144) % 524288 + 524288) % 524288 - 262144) AS g FROM v),
j AS (SELECT e.doc_id, e.n, e.edited, f.fp AS ff, x.fp AS ef, y.fp AS nf, list_dot_product(CAST(f.g AS DOUBLE[]), CAST(x.g AS DOUBLE[])) AS fe, list_dot_product(CAST(f.g AS DOUBLE[]), CAST(y.g AS DOUBLE[])) AS fn,
        list_dot_product(CAST(f.g AS DOUBLE[]), CAST(f.g AS DOUBLE[])) AS qf, list_dot_product(CAST(x.g AS DOUBLE[]), CAST(x.g AS DOUBLE[])) AS qe, list_dot_product(CAST(y.g AS DOUBLE[]), CAST(y.g AS DOUBLE[])) AS qn
      FROM e JOIN l f ON f.doc_id = e.doc_id AND f.kind = 'f' JOIN l x ON x.doc_id = e.doc_id AND x.kind = 'e' JOIN l y ON y.doc_id = e.doc_id AND y.kind = 'n')
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, ff AS fingerprint, ef AS edited_fingerprint,
       CASE WHEN ff = ef THEN 1.0::DOUBLE WHEN qf * qe > 0 THEN round(least(greatest(fe / sqrt(qf * qe), 0), 1), 6) ELSE 0.0::DOUBLE END AS near_edited,
       CASE WHEN ff = nf THEN 1.0::DOUBLE WHEN qf * qn > 0 THEN round(least(greatest(fn / sqrt(qf * qn), 0), 1), 6) ELSE 0.0::DOUBLE END AS near_next
FROM j
""".format(sums=", ".join(f"coalesce(sum(({x[0]} >> {x[1:]}) & 1), 0) % 524288 AS {x}" for x in _LANES), bits=", ".join(_LANES))


# crc32 by its table of bytes; a state's value is its cost, nine digits long, and its audit, so that the least string is the least value
_TO = "format('{{:09d}}', CAST(left({0}, 9) AS INT) + {1}) || substr({0}, 10) || '{2}'"
_EXT = lambda k, cost, letter: _TO.format(k, cost, letter)
_KEEP = lambda k, initial: f"CASE WHEN NOT must AND ini = '{initial}' THEN {_EXT(k, '3 * tr', 'K')} ELSE '900000000' END"
_TURN = lambda k: f"CASE WHEN must THEN '900000000' ELSE {_EXT(k, '3 + 3 * tr', 'R')} END"
OP12_SQL = f"""
WITH RECURSIVE bits AS (SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8),
rows AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
coded AS (SELECT rows.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])), 4294967295) % 20 AS code FROM rows, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
placed AS (SELECT *, coalesce(conv_id, -1) AS c, conv_id IS NULL AS cn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM hurt),
faults AS (SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
msg AS (SELECT *, blank OR dup AS must, CAST(NOT blank AND NOT dup AND right(seen, 1) NOT IN ('.', '!', '?') AS INT) AS tr FROM faults),
step AS (SELECT c, cn, 0 AS i, '000000000' AS z, '900000000' AS y, '000000003I' AS u, '000000006II' AS a FROM msg GROUP BY c, cn
  UNION ALL
  SELECT c, cn, i, z, y, least(u0, {_EXT("z", 3, "I")}, {_EXT("y", 3, "I")}, {_EXT("a0", 3, "I")}), least(a0, {_EXT("least(u0, " + _EXT("z", 3, "I") + ", " + _EXT("y", 3, "I") + ")", 3, "I")}) FROM (
    SELECT c, cn, i, {_EXT("z", 4, "D")} AS z, least({_EXT("y", 4, "D")}, {_KEEP("z", "s")}) AS y,
      least({_EXT("u", 4, "D")}, {", ".join(f(k) for k in "zya" for f in (lambda k: _KEEP(k, "u"), _TURN))}) AS u0, least({_EXT("a", 4, "D")}, {_KEEP("u", "a")}, {_TURN("u")}) AS a0
    FROM (SELECT s.c, s.cn, m.i, s.z, s.y, s.u, s.a, m.must, m.tr, m.ini FROM step s JOIN msg m ON m.c = s.c AND m.cn = s.cn AND m.i = s.i + 1))),
best AS (SELECT c, cn, least(z, a) AS v FROM step QUALIFY row_number() OVER (PARTITION BY c, cn ORDER BY i DESC) = 1),
edits AS (SELECT c, cn, substr(v, 10) AS audit, unnest(string_split(substr(v, 10), '')) AS e, unnest(range(1, length(v) - 8)) AS pos FROM best WHERE length(v) > 9),
dealt AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c, cn ORDER BY pos) AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c, cn ORDER BY pos) AS n FROM edits),
lines AS (SELECT d.c, d.cn, d.pos, d.e, d.n, CASE WHEN d.e <> 'I' THEN m.role END AS role, CASE WHEN d.e = 'I' THEN '' ELSE m.text END AS text FROM dealt d LEFT JOIN msg m ON m.c = d.c AND m.cn = d.cn AND m.i = d.i WHERE d.e <> 'D'),
led AS (SELECT *, first_value(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c, cn ORDER BY pos) AS lead FROM lines),
done AS (SELECT c, cn, string_agg(CASE WHEN e = 'K' THEN role WHEN (n - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS body FROM led GROUP BY c, cn),
per AS (SELECT c, cn, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, sum(tr) AS truncated, count_if(before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM msg GROUP BY c, cn),
ids AS (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS c, conv_id IS NULL AS cn FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(left(v, 9) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(v, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN per USING (c, cn) LEFT JOIN best USING (c, cn) LEFT JOIN done USING (c, cn)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op9_fingerprint": OP9_SQL, "op12_conversation": OP12_SQL}
