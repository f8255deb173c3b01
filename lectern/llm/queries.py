"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann_forest, html_extract, lang_id, line_dedup, packing, piece_bpe, pu_quality, repetition, simhash, toxicity, url_filter, vector_codes
from lectern.llm.common import fold, table


def held_out(modulus: int, left: int) -> Column:
    """Rows that nothing is learned from; rows without an id are not held out, and teach nothing either."""
    return F.coalesce(fold(F.col("doc_id"), modulus) == left, F.lit(False))


#: Action, host, start of the path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = lang_id.train(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    return lang_id.identify(docs, models).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, most_bits=4)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("component")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pu_quality.train(docs.where(~held_out(3, 1)), labels.where(~held_out(3, 1)).select("doc_id", F.col("quality").alias("label")))
    scored = pu_quality.score(docs, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(~held_out(4, 2)), labels.where(~held_out(4, 2)).select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    ten = (op1_html_extract, op2_language_id, op3_piece_bpe, op4_simhash, op5_repetition, op6_prefix_forest, op7_url_filter, op8_packing, op9_pu_quality, op10_toxicity)
    return {f.__name__: f for f in (*ten, op11_vector_codes, op12_line_dedup)}


def _url_sql() -> str:
    """The verdicts of op7 in SQL: rules by a join, references resolved by rewriting, aliases by walking the links."""
    host = lambda u: f"coalesce(translate(split_part(split_part(split_part(substr({u}, strpos({u}, '://') + 3), '/', 1), '?', 1), '#', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '')"
    after = lambda u: f"split_part(substr({u}, strpos({u}, '://') + 3), '#', 1)"
    path = lambda u: f"coalesce(regexp_extract(split_part({after(u)}, '?', 1), '(?s)/.*'), '')"
    query = lambda u: f"CASE WHEN strpos({after(u)}, '?') > 0 THEN substr({after(u)}, strpos({after(u)}, '?')) ELSE '' END"
    value = lambda tag, name: f"trim(regexp_replace(regexp_extract({tag}, '(?is)[\\s\"''/]{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1), '^[\"'']|[\"'']$', '', 'g'))"
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
    skipped = "|".join(rf"<{x}\b.*?(?:</{x}|$)" for x in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"))
    names = {"colon": ":", "sol": "/", "period": ".", "quest": "?", "equals": "=", "num": "#", "lt": "<", "gt": ">"}
    number = "CASE WHEN m[2:2] IN ('x', 'X') THEN try_cast('0' || lower(m[2:]) AS BIGINT) ELSE try_cast(m[2:] AS BIGINT) END"
    sign = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE CASE WHEN m[1] <> '#' THEN '&' || m || ';' WHEN ({number}) BETWEEN 33 AND 126 THEN chr(({number})::INT) ELSE '' END END"
    whole = lambda host, path: f"CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN ref LIKE '//%' THEN 'x:' || ref WHEN ref LIKE '/%' THEN 'x://' || {host} || ref WHEN ref LIKE '?%' OR ref LIKE '#%' THEN 'x://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || ref ELSE 'x://' || {host} || '/' || array_to_string(string_split({path}, '/')[2:-2], '/') || CASE WHEN len(string_split({path}, '/')) > 2 THEN '/' ELSE '' END || ref END"
    return rf"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id, url, html, url IS NOT NULL AND strpos(url, '://') > 0 AS ok FROM pages),
p AS (SELECT k, page_id, html, CASE WHEN ok THEN {host('url')} ELSE '' END AS host, CASE WHEN ok THEN {path('url')} ELSE '' END AS path, CASE WHEN ok THEN {query('url')} END AS query, substr(url, 1, strpos(url, '://') - 1) AS scheme FROM u),
t0 AS (SELECT k, regexp_extract_all(html, '(?is)<!--.*?(?:-->|$)|{skipped}|<[a-z/](?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')?)*>') AS found FROM p WHERE host <> '' AND regexp_matches(html, '(?i)<link|http-equiv')),
t AS (SELECT k, unnest(found) AS tag, unnest(range(len(found))) AS i FROM t0),
r AS (SELECT k, i, lower(tag[2:5]) = 'base' AS base, CASE WHEN lower(tag[2:5]) = 'link' AND list_contains(regexp_split_to_array(lower({value('tag', 'rel')}), '\s+'), 'canonical') OR lower(tag[2:5]) = 'base' THEN {value('tag', 'href')}
      WHEN lower(tag[2:5]) = 'meta' AND lower({value('tag', 'http-equiv')}) = 'refresh' THEN regexp_extract({value('tag', 'content')}, '(?is)^[^;,]*[;,]\s*url\s*=\s*[\"'']?\s*([^\"'']*)', 1) END AS ref FROM t WHERE regexp_matches(tag, '(?i)^<(link|meta|base)[\s/]')),
d AS (SELECT k, i, base, ref, list_distinct(regexp_extract_all(ref, '&(#[xX]?[0-9a-fA-F]{{1,6}}|[a-z]+);', 1)) AS signs FROM r WHERE ref <> ''),
c AS (SELECT k, i, base, trim(regexp_replace(replace(list_reduce(list_prepend(ref, list_filter(signs, lambda m: m <> 'amp')), lambda s, m: replace(s, '&' || m || ';', {sign})), '&amp;', '&'), '[\t\n\f\r]', '', 'g')) AS ref FROM d),
bs AS (SELECT k, host, path, arg_min(ref, i) AS ref FROM c JOIN p USING (k) WHERE base AND ref <> '' GROUP BY ALL),
bw AS (SELECT k, {host('whole')} AS host, {path('whole')} AS path FROM (SELECT k, {whole('host', 'path')} AS whole FROM bs) WHERE regexp_matches(whole, '^[A-Za-z][A-Za-z0-9+.-]*://')),
v AS (SELECT p.k, p.host || CASE WHEN p.path = '' THEN '/' ELSE p.path END || p.query AS src, CASE WHEN bw.host <> '' THEN bw.host ELSE p.host END AS host, CASE WHEN bw.host <> '' THEN bw.path ELSE p.path END AS path FROM p LEFT JOIN bw USING (k)),
w AS (SELECT src, {whole('host', 'path')} AS whole FROM c JOIN v USING (k) WHERE ref <> '' AND NOT base),
e0 AS (SELECT src, {host('whole')} || CASE WHEN {path('whole')} = '' THEN '/' ELSE {path('whole')} END || {query('whole')} AS dst FROM w WHERE regexp_matches(whole, '^[A-Za-z][A-Za-z0-9+.-]*://') AND {host('whole')} <> ''),
names AS (SELECT src AS raw FROM e0 UNION SELECT dst FROM e0 UNION SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || query FROM p WHERE host <> ''),
dots AS (SELECT raw, split_part(raw, '?', 1) AS now, substr(raw, length(split_part(raw, '?', 1)) + 1) AS query FROM names UNION
      SELECT raw, CASE WHEN regexp_matches(now, '/\.(/|$)') THEN regexp_replace(now, '/\.(/|$)', '/') WHEN regexp_matches(now, '^[^/]*/\.\.(/|$)') THEN regexp_replace(now, '^([^/]*)/\.\.(/|$)', '\1/') ELSE regexp_replace(now, '/[^/]*/\.\.(/|$)', '/') END, query FROM dots WHERE regexp_matches(now, '/\.\.?(/|$)')),
clean AS (SELECT raw, now || query AS node FROM dots WHERE NOT regexp_matches(now, '/\.\.?(/|$)')),
e AS (SELECT a.node AS src, b.node AS dst FROM e0 JOIN clean a ON a.raw = e0.src JOIN clean b ON b.raw = e0.dst), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT src AS a, dst AS z FROM b UNION SELECT r.a, b.dst FROM reach r JOIN b ON r.z = b.src),
n AS (SELECT DISTINCT a, z, split_part(split_part(z, '/', 1), '?', 1) AS host, regexp_extract(split_part(z, '?', 1), '(?s)/.*') AS path FROM reach),
nr AS (SELECT n.a, arg_max(r.action, length(r.host || r.path)) AS action FROM n JOIN rules r ON (n.host = r.host OR suffix(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY n.a, n.z),
bad AS (SELECT DISTINCT a FROM nr WHERE action = 'block'),
own AS (SELECT p.k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action FROM p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.k)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.action, CASE WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN own USING (k) LEFT JOIN clean ON clean.raw = p.host || CASE WHEN p.path = '' THEN '/' ELSE p.path END || p.query LEFT JOIN bad ON bad.a = clean.node"""


def _repetition_sql() -> str:
    """The counts of op5 in SQL: repeated runs of n words or more are the union of repeated windows of n words."""
    word = "[^\\x20\\x09-\\x0D]"
    window = lambda n: f"SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, hash(a[i:i + {n - 1}])) AS c FROM (SELECT k, a, unnest(range(1, len(a) - {n - 2})) AS i FROM w WHERE len(a) >= {n})) WHERE c > 1"
    covered = lambda n: f"SELECT k, count(DISTINCT i + j)::BIGINT AS n FROM ({window(n)}) CROSS JOIN range({n}) t(j) GROUP BY k"
    return f"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS a FROM documents),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w),
r AS ({covered(5)}), c AS ({covered(10)}), g AS (SELECT DISTINCT k FROM ({window(51)})),
b AS (SELECT w.k, doc_id, len(a)::BIGINT AS n_words, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered, g.k IS NOT NULL AS long_repeat
      FROM w JOIN l USING (k) LEFT JOIN r USING (k) LEFT JOIN c USING (k) LEFT JOIN g USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, base_failed, NOT base_failed AND n_covered <= 0.2 * n_words AND NOT long_repeat AS kept FROM f"""


def _codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """The codes of op11 in SQL: every distance in every round, whole numbers held in doubles."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (SELECT r, p, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * {entries} + e)::BIGINT AS best FROM parts JOIN book{k} USING (p) GROUP BY r, p),
a{k} AS MATERIALIZED (SELECT r, p, best % {entries} AS e, best // {entries} AS square FROM d{k}),
s{k} AS (SELECT p, e, i, sum(v)::BIGINT AS total, count(*) AS n FROM (SELECT p, e, unnest(x)::BIGINT AS v, unnest(range(len(x))) AS i FROM a{k} JOIN parts USING (r, p)) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN m{k} USING (p, e)),""")
    return f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v: floor(v * 1024)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM whole WHERE len(x) = (SELECT len(x) FROM whole ORDER BY vec_id NULLS LAST, x LIMIT 1)),
parts AS MATERIALIZED (SELECT r, p, x[len(x) * p // 4 + 1:len(x) * (p + 1) // 4] AS x FROM kept CROSS JOIN range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {entries}),{"".join(steps)}
sha AS (SELECT sha256(coalesce(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i), '')) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM book{rounds})),
codes AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(square)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (r) CROSS JOIN sha"""


def _lines_sql() -> str:
    """The rows of op12 in SQL, by the whole keys of lines."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
y AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM y WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT y.*, f.keeper IS NOT NULL AND y.doc_id IS DISTINCT FROM f.keeper AS gone FROM y LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY k"""


def oracle_sql() -> dict[str, str]:
    return {"op5_repetition": _repetition_sql(), "op7_url_filter": _url_sql(), "op11_vector_codes": _codes_sql(), "op12_line_dedup": _lines_sql()}
