"""Queries over conversations, events and pages of listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import conversation as C
from lectern.operators import paging as G
from lectern.plans.registry import query
from lectern.plans.text import collapsed, stripped
from lectern.sources.tables import table
from lectern.streaming import markers as M


def talk(spark, d):
    return table(spark, d, "conversations")


SAID = (
    "SELECT conv_id, turn, (conv_id % 4)::INT AS n_sources, CASE turn % 5 WHEN 0 THEN text || ' [1]' WHEN 1 THEN '[2, 9] ' || text WHEN 2 THEN text || ' [ 3 ,1 ] end [sic]' WHEN 3 THEN '[0][99] ' || text ELSE text || ' [1' END AS text FROM conversations WHERE role = 'assistant'"
)


def answers(spark, d):
    """Assistant turns with markers put in; none to three sources."""
    k = F.col("turn") % 5
    text = (
        F.when(k == 0, F.concat("text", F.lit(" [1]"))).when(k == 1, F.concat(F.lit("[2, 9] "), "text")).when(k == 2, F.concat("text", F.lit(" [ 3 ,1 ] end [sic]")))
        .when(k == 3, F.concat(F.lit("[0][99] "), "text")).otherwise(F.concat("text", F.lit(" [1")))
    )
    return talk(spark, d).where("role = 'assistant'").select("conv_id", "turn", (F.col("conv_id") % 4).cast("int").alias("n_sources"), text.alias("text"))


MARK = X.MARKER
KEPT = "list_filter(list_transform(regexp_extract_all({m}, '[0-9]+'), lambda x: x::INT), lambda i: i >= 1 AND i <= n_sources)"
PARTS = f"(SELECT conv_id, turn, n_sources, text, string_split_regex(text, '{MARK}') AS p, regexp_extract_all(text, '{MARK}') AS m FROM ({SAID}))"
VALID = "list_reduce(list_transform(range(1, len(p) + 1), lambda j: p[j] || coalesce(array_to_string(list_transform(" + KEPT.replace("{m}", "m[j]") + ", lambda i: '[' || i || ']'), ''), '')), lambda a, b: a || b)"
USED = "list_sort(list_distinct(flatten(list_transform(m, lambda y: " + KEPT.replace("{m}", "y") + "))))"


@query(f"SELECT conv_id, turn, {VALID} AS text FROM {PARTS}")
def marker_validate(spark, d):
    return answers(spark, d).select("conv_id", "turn", X.valid_markers(F.col("text"), F.col("n_sources")).alias("text"))


@query(f"SELECT conv_id, turn, array_to_string({USED}, ',') AS used FROM {PARTS}")
def citations_used(spark, d):
    used = F.transform(X.markers_used(F.col("text"), F.col("n_sources")), lambda i: i.cast("string"))
    return answers(spark, d).select("conv_id", "turn", F.array_join(used, ",").alias("used"))


@query(f"SELECT conv_id, turn, regexp_replace(text, '{MARK}', '', 'g') AS text FROM ({SAID})")
def strip_markers(spark, d):
    return answers(spark, d).select("conv_id", "turn", X.strip_markers(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, text, len(list_filter(regexp_extract_all(text, '\\[([0-9]{{1,3}})\\]', 1), lambda x: x::INT >= 1 AND x::INT <= n_sources))::BIGINT AS chips FROM ({SAID})")
def answer_segments(spark, d):
    """Segments of an answer for display, put together again, and how many are citations."""
    found = C.segments(answers(spark, d))
    order = F.array_sort(F.collect_list(F.struct("position", "raw")))
    return found.groupBy("conv_id", "turn").agg(F.array_join(F.transform(order, lambda x: x["raw"]), "").alias("text"), F.count_if(F.col("kind") == "citation").alias("chips"))


def pieces(spark, d):
    """Answers cut into pieces of seven characters, so that markers tear."""
    whole = answers(spark, d).groupBy("conv_id").agg(F.first("n_sources").alias("n_sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    cut = whole.select("conv_id", "n_sources", "text", F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / 7).cast("int"))).alias("seq"))
    return cut.select("conv_id", "n_sources", "seq", F.expr("substring(text, seq * 7 + 1, 7)").alias("delta"))


FILTERED = (f"SELECT conv_id, {VALID.replace('m[j]', 'm[j]')} AS text FROM (SELECT conv_id, n_sources, string_split_regex(text, '{MARK}') AS p, regexp_extract_all(text, '{MARK}') AS m FROM (SELECT conv_id, any_value(n_sources) AS n_sources, regexp_replace(string_agg(text, ' ' ORDER BY turn), '\\[[0-9, \\t\\n\\r]*$', '') AS text FROM ({SAID}) GROUP BY conv_id))")


@query(FILTERED)
def marker_stream(spark, d):
    """The pieces of every answer joined, and filtered by column expressions."""
    return M.filter_deltas(pieces(spark, d)).select("conv_id", "text")


@query(FILTERED)
def marker_pieces(spark, d):
    """Every piece filtered as it arrives, with what those before it left open."""
    return M.filter_pieces(pieces(spark, d)).select("conv_id", "text")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def history_last_n(spark, d):
    return C.last_messages(talk(spark, d)).select("conv_id", "turn", "role", "text")


@query(
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
t AS (SELECT conv_id, turn, role, {stripped("CASE WHEN role = 'assistant' THEN regexp_replace(text, '" + MARK + "', '', 'g') ELSE text END")} AS content FROM m WHERE rn <= 6 AND role IN ('user', 'assistant')),
f AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS change FROM t WHERE content <> ''),
g AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f),
r AS (SELECT conv_id, run, any_value(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS content FROM g GROUP BY conv_id, run),
b AS (SELECT *, min(CASE WHEN role = 'user' THEN run END) OVER (PARTITION BY conv_id) AS first, max(CASE WHEN role = 'assistant' THEN run END) OVER (PARTITION BY conv_id) AS last FROM r)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY run) AS position, role, content FROM b WHERE run >= first AND run <= last"""
)
def history_messages(spark, d):
    return C.shape_history(C.last_messages(talk(spark, d))).select("conv_id", F.col("position").cast("long").alias("position"), "role", "content")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 5 ORDER BY turn")
def transcript(spark, d):
    return talk(spark, d).where("conv_id = 5").select("conv_id", "turn", "role", "text").orderBy("turn")


@query("SELECT conv_id, max(turn) AS last_turn, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC")
def list_conversations(spark, d):
    return talk(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n")).orderBy(F.desc("last_turn"), F.desc("conv_id"))


@query(f"SELECT conv_id, substring({collapsed('text')}, 1, 60) AS title FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def conversation_title(spark, d):
    first = talk(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", X.title(F.col("text")).alias("title"))


@query(
    "SELECT conv_id, turn, 'user' AS role, text AS content, 0::BIGINT AS n_citations FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'assistant', text, (conv_id % 4)::BIGINT FROM conversations WHERE role = 'assistant' AND turn % 5 <> 4"
)
def message_persist(spark, d):
    """What is stored: every question, and the answers that came to their end, with their citations."""
    asked = talk(spark, d).where("role = 'user'").select("conv_id", "turn", "role", F.col("text").alias("content"), F.lit(0).cast("long").alias("n_citations"))
    done = talk(spark, d).where("role = 'assistant' and turn % 5 <> 4").select("conv_id", "turn", "role", F.col("text").alias("content"), F.col("conv_id") % 4)
    return asked.union(done)


FRAMES = "SELECT conv_id AS id, string_agg('event: ' || CASE role WHEN 'user' THEN 'token' ELSE 'note' END || chr(10) || 'data: {\"turn\":' || turn || '}' || chr(10) || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id"


def bodies(spark, d):
    name = F.when(F.col("role") == "user", "token").otherwise("note")
    rows = talk(spark, d).select("conv_id", "turn", C.frame(name, F.to_json(F.struct("turn"))).alias("f"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "f")))
    return rows.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(parts, lambda x: x["f"]), "").alias("body"))


@query(FRAMES)
def sse_frames(spark, d):
    return bodies(spark, d)


@query("SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, CASE role WHEN 'user' THEN 'token' ELSE 'note' END AS event, '{\"turn\":' || turn || '}' AS data FROM conversations")
def sse_decode(spark, d):
    noisy = bodies(spark, d).withColumn("body", F.concat(F.lit(": ping\n\n"), F.col("body"), F.lit(": end\n\n")))
    return C.decode_frames(noisy).select("id", F.col("position").cast("long").alias("position"), "event", "data")


@query("SELECT conv_id AS id, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 'done without id' WHEN 2 THEN 'ignored' ELSE 'token without text' END AS problem FROM conversations")
def sse_validate(spark, d):
    k = F.col("turn") % 4
    event = F.when(k == 0, "token").when(k == 1, "done").when(k == 2, "hello").otherwise("token")
    data = F.when(k == 0, F.to_json(F.struct("text"))).when(k == 1, '{"message_id":null}').when(k == 2, "{}").otherwise('{"txt":1}')
    return talk(spark, d).select(F.col("conv_id").alias("id"), "turn", C.event_problem(event, data).alias("problem"))


@query(
    f"SELECT conv_id, turn, s.seq::INT AS seq, CASE s.seq WHEN 1 THEN 'retrieval' WHEN 2 THEN 'token' ELSE 'done' END AS event, CASE s.seq WHEN 1 THEN (n_sources = 0)::VARCHAR WHEN 2 THEN CASE WHEN n_sources = 0 THEN '{C.REFUSAL}' ELSE {VALID} END ELSE '[' || CASE WHEN n_sources = 0 THEN '' ELSE array_to_string({USED}, ',') END || ']' END AS value FROM {PARTS} CROSS JOIN (SELECT unnest([1, 2, 3]) AS seq) s"
)
def answer_events(spark, d):
    e = C.answer_events(answers(spark, d))
    value = F.when(F.col("event") == "retrieval", F.get_json_object("data", "$.insufficient_context")).when(F.col("event") == "token", F.get_json_object("data", "$.text")).otherwise(F.get_json_object("data", "$.citations_used"))
    return e.select("conv_id", "turn", "seq", "event", value.alias("value"))


@query("SELECT conv_id, turn, (CASE WHEN turn % 7 = 3 THEN 1 ELSE 0 END)::BIGINT AS violations FROM conversations WHERE role = 'assistant'")
def event_order_violations(spark, d):
    """Streams of events some of which have lost their end."""
    e = C.answer_events(answers(spark, d)).where("not (turn % 7 = 3 and event = 'done')")
    return C.order_violations(e, ("conv_id", "turn")).select("conv_id", "turn", F.col("violations").cast("long").alias("violations"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'error' ELSE 'done' END AS phase, CASE WHEN n_sources = 0 THEN '{C.REFUSAL}' ELSE {VALID} END AS text FROM {PARTS}")
def ask_fold(spark, d):
    e = C.answer_events(answers(spark, d)).where("not (turn % 7 = 3 and event = 'done')")
    return C.fold(e, ("conv_id", "turn"))


@query(f"SELECT conv_id, turn, CASE WHEN n_sources = 0 THEN '{C.REFUSAL}' END AS refusal FROM ({SAID})")
def grounding_refusal(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.when(F.col("n_sources") == 0, C.REFUSAL).alias("refusal"))


@query("SELECT o_orderkey, o_orderdate, true AS has_more FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def keyset_page(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return G.newest_first(rows, "o_orderdate", "o_orderkey", 50, ("1998-01-01 00:00:00", 5000)).select("o_orderkey", "o_orderdate", "has_more")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 50 WHEN 1 THEN NULL WHEN 2 THEN 200 ELSE (o_orderkey % 150 + 1)::INT END AS size FROM orders")
def limit_clamp(spark, d):
    k = F.col("o_orderkey")
    asked = F.when(k % 4 == 0, None).when(k % 4 == 1, 0).when(k % 4 == 2, 1000).otherwise(k % 150 + 1).cast("int")
    return table(spark, d, "orders").select("o_orderkey", G.clamp(asked).alias("size"))


@query("SELECT o_orderkey, rtrim(replace(replace(base64(encode('{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '?>~\"}')), '+', '-'), '/', '_'), '=') AS cursor, o_orderkey AS id, o_orderstatus || '?>~' AS status FROM orders")
def cursor_roundtrip(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit("?>~")).alias("status")).alias("payload"))
    coded = rows.withColumn("cursor", G.encode_cursor(F.col("payload")))
    return coded.withColumn("back", G.decode_cursor(F.col("cursor"), "id bigint, status string")).select("o_orderkey", "cursor", "back.id", "back.status")


@query("SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'page' ELSE 'old' END AS origin FROM documents")
def merge_page(spark, d):
    """A page of long documents put before a list of all."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    page, old = rows.where("n_chars > 3000").withColumn("origin", F.lit("page")), rows.withColumn("origin", F.lit("old"))
    return G.merge_page(page, old, "doc_id").drop("n_chars")


@query("SELECT event_id, coalesce(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 15000000.0), 0)::BIGINT AS pings FROM events")
def heartbeat_frames(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    return C.heartbeats(rows, "user_id", "ts", "event_id").select("event_id", "pings")
