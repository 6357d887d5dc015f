"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, jaccard, media, packing, perplexity, pii, repeats, rules, spelling, toxicity, turns, wavelet


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(_documents(spark, sf_dir))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_documents(spark, sf_dir))


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_documents(spark, sf_dir), _fold(7) == 2)


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_documents(spark, sf_dir))


def op4_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _fold(4) != 2)
    found = toxicity.score(docs, model, with_spans=True)
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), spans.alias("toxic_spans"))


def op2_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf_dir))


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.load(media.store(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "media"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return perplexity.classify(_documents(spark, sf_dir), labels.where("quality = 1"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_documents(spark, sf_dir)))


def op13_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.classify(_documents(spark, sf_dir), labels.where("quality = 1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_retrieval_packing": op1_retrieval_packing,
    "op6_pii_spans": op6_pii_spans,
    "op10_context_tree": op10_context_tree,
    "op9_difference_cover": op9_difference_cover,
    "op4_toxic_spans": op4_toxic_spans,
    "op2_prefix_jaccard": op2_prefix_jaccard,
    "op3_simhash_decontamination": op3_simhash_decontamination,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op7_kneser_ney_quality": op7_kneser_ney_quality,
    "op5_wavelet_tokens": op5_wavelet_tokens,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_perplexity_rules": op13_perplexity_rules,
}

#: The table of the 32-bit cyclic redundancy check, by its rule, and the check of bytes ``x`` given as a list of numbers.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc(x: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {x}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_WORDS = r"[^\x20\x09-\x0D]+"

#: What SQL can express and run on whole tables.  The other queries are tested against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op2_prefix_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4) UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON b.k = a.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id)::BIGINT AS component_id FROM documents d LEFT JOIN n USING (doc_id)""",
    "op9_difference_cover": rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)), m AS (SELECT k, min(doc_id) AS low FROM v GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM v JOIN m USING (k) WHERE low < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w), q AS (SELECT p.doc_id, count(g.p) AS gone, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN q USING (doc_id)""",
    "op11_conversation_repair": rf"""WITH RECURSIVE {_CRC_TABLE},
m(s, ins, roles, mid) AS (VALUES (0, '', []::VARCHAR[], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3), (1, '', []::VARCHAR[], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3), (2, '', []::VARCHAR[], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2), (3, '', []::VARCHAR[], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
e(mid, letter, initial, role, goal, price) AS (VALUES (0, 'K', 's', '', 1, 0), (0, 'K', 'u', '', 2, 0), (1, 'K', 'u', '', 2, 0), (2, 'K', 'a', '', 3, 0), (3, 'K', 'u', '', 2, 0), (0, 'R', '', 'user', 2, 2), (1, 'R', '', 'user', 2, 2), (2, 'R', '', 'assistant', 3, 2), (3, 'R', '', 'user', 2, 2), (0, 'D', '', '', 0, 3), (1, 'D', '', '', 1, 3), (2, 'D', '', '', 2, 3), (3, 'D', '', '', 3, 3)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT k.*, {_crc("list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)")} % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM d),
f AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
p AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM g
UNION ALL SELECT conv_id, i, goal, min(best) FROM (SELECT p.conv_id, f.i, goal, {{'cost': (best.cost + 2 * length(ins) + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END)::INTEGER, 'audit': best.audit || ins || letter, 'lines': list_concat(best.lines, roles, CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END)}} AS best FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN m ON m.s = p.s JOIN e ON e.mid = m.mid WHERE letter = 'D' OR fault IN ('', 'truncated') AND (letter = 'R' OR initial = left(f.role, 1))) GROUP BY conv_id, i, goal),
q AS (SELECT p.conv_id, min({{'cost': best.cost + 2 * length(ins), 'audit': best.audit || ins, 'lines': list_concat(best.lines, roles)}}) AS best FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.n = p.i JOIN m ON m.s = p.s WHERE m.mid = 3 OR m.mid = 0 GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_spelling_variants": rf"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r WHERE length(run) >= 7 GROUP BY id, run),
h AS (SELECT run, n, {_crc("list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)")} AS h FROM o, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, i, left(word, i) || '*' || substr(word, i + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM v)), gaps AS (SELECT word, left(word, i) || '*' || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(length(word) + 1)) AS i FROM v)),
d AS (SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON b.k = a.k AND b.word <> a.word UNION SELECT a.word, b.word FROM holes a JOIN gaps b ON b.k = a.k UNION SELECT b.word, a.word FROM holes a JOIN gaps b ON b.k = a.k),
m AS (SELECT a, count(*) AS n_near, min({{'less': -v.n, 'form': b}}) AS best FROM d JOIN v ON v.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.form END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM v LEFT JOIN m ON a = word),
t AS (SELECT word, form AS root, 1 AS depth FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT word, arg_max(root, depth) AS root FROM t GROUP BY word) l ON l.word = f.word""",
}
