"""Conversations: history, transcripts, prompts, event frames and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

HISTORY = 6
# Fixed value: the sentence that stands for an answer without sources.
REFUSAL = "I could not find anything about that in your documents."


def last_messages(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """The newest n messages of each conversation (conv_id, turn, role, text)."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n).drop("rn")


def shape_history(messages: DataFrame) -> DataFrame:
    """Messages as a model takes them: (conv_id, position, role, content).

    Other roles and blank messages go, assistants lose their markers, neighbours of one
    role become one, and the run starts with a user and ends with an assistant.
    """
    content = X.strip(F.when(F.col("role") == "assistant", X.strip_markers(F.col("text"))).otherwise(F.col("text")))
    told = messages.where(F.col("role").isin("user", "assistant")).withColumn("content", content).where("content <> ''")
    turn = Window.partitionBy("conv_id").orderBy("turn")
    told = told.withColumn("change", F.coalesce(F.col("role") != F.lag("role").over(turn), F.lit(True)).cast("int"))
    told = told.withColumn("run", F.sum("change").over(turn))
    parts = F.array_sort(F.collect_list(F.struct("turn", "content")))
    runs = told.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("content"))
    whole = Window.partitionBy("conv_id")
    runs = runs.withColumn("first", F.min(F.when(F.col("role") == "user", F.col("run"))).over(whole)).withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("run"))).over(whole))
    kept = runs.where("run >= first and run <= last")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("run"))).select("conv_id", "position", "role", "content")


def render_source(index: Column, filename: Column, text: Column, pages: Column | None = None, heading: Column | None = None) -> Column:
    """One source of a prompt: its attributes, escaped, and its text."""
    attribute = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f' {name}="'), X.escape_attribute(c), F.lit('"'))).otherwise("")
    more = [attribute("pages", pages)] if pages is not None else []
    more += [attribute("heading", heading)] if heading is not None else []
    return F.concat(F.lit('<source index="'), index.cast("string"), F.lit('" file="'), X.escape_attribute(filename), F.lit('"'), *more, F.lit(">\n"), X.strip(text), F.lit("\n</source>"))


def prompt_block(sources: DataFrame, by: tuple = ("question_id",)) -> DataFrame:
    """All sources (index, filename, text) of a question as one text, in order."""
    made = sources.withColumn("source", render_source(F.col("index"), F.col("filename"), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("index", "source")))
    return made.groupBy(*by).agg(F.concat(F.lit("Sources:\n\n"), F.array_join(F.transform(ordered, lambda x: x["source"]), "\n\n")).alias("block"))


def frame(event: Column, data: Column) -> Column:
    """A server-sent event with one line of JSON."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def decode_frames(bodies: DataFrame) -> DataFrame:
    """Events (id, position, event, data) of whole bodies (id, body).

    Frames end with a blank line; comments and frames without data are dropped, data lines
    are joined, and a frame without a name is a message.
    """
    frames = bodies.select("id", F.posexplode(F.split(X.newlines(F.col("body")), "\n\n")).alias("position", "frame"))
    lines = F.filter(F.split("frame", "\n"), lambda x: (x != "") & ~x.startswith(":"))
    value = lambda x: F.regexp_replace(F.regexp_replace(x, "^[^:]*:?", ""), "^ ", "")
    named = F.filter(lines, lambda x: x.startswith("event"))
    data = F.filter(lines, lambda x: x.startswith("data"))
    found = frames.select("id", "position", F.coalesce(F.try_element_at(F.transform(named, value), F.lit(-1)), F.lit("message")).alias("event"), F.when(F.size(data) > 0, F.array_join(F.transform(data, value), "\n")).alias("data"))
    return found.where("data is not null")


def event_problem(event: Column, data: Column) -> Column:
    """Why a decoded event breaks the protocol, null if it does not; unknown events pass as ignored."""
    text = F.get_json_object(data, "$.text")
    return (
        F.when(event == "token", F.when(text.isNull(), "token without text"))
        .when(event == "done", F.when(F.get_json_object(data, "$.message_id").isNull(), "done without id"))
        .when(event == "error", F.when(F.get_json_object(data, "$.error").isNull(), "error without copy"))
        .when(event == "retrieval", F.when(F.get_json_object(data, "$.sources").isNull(), "retrieval without sources"))
        .otherwise("ignored")
    )


def segments(answers: DataFrame) -> DataFrame:
    """Answers (conv_id, turn, n_sources, text) as segments: (position, kind, raw), text between citations.

    A marker of one number within the sources is a citation; any other stays text.
    """
    single = r"\[[0-9]{1,3}\]"
    parts = F.split("text", single, -1)
    marks = F.regexp_extract_all("text", F.lit(single), F.lit(0))
    known = lambda m: F.regexp_extract(m, "[0-9]+", 0).cast("int").between(1, F.col("n_sources"))
    item = lambda kind, raw: F.struct(kind.alias("kind"), raw.alias("raw"))
    pairs = F.transform(F.arrays_zip(parts.alias("p"), marks.alias("m")), lambda z: F.array(item(F.lit("text"), z["p"]), item(F.when(known(z["m"]), "citation").otherwise("text"), F.coalesce(z["m"], F.lit("")))))
    rows = answers.select("conv_id", "turn", F.posexplode(F.flatten(pairs)).alias("position", "s"))
    return rows.select("conv_id", "turn", "position", "s.kind", "s.raw").where("raw <> ''")


def answer_events(answers: DataFrame) -> DataFrame:
    """The events of answers (conv_id, n_sources, text): retrieval, tokens, done, in order.

    Without sources no model is asked: the only token is the refusal.
    """
    said = F.when(F.col("n_sources") == 0, F.lit(REFUSAL)).otherwise(X.valid_markers(F.col("text"), F.col("n_sources")))
    used = F.when(F.col("n_sources") == 0, F.array().cast("array<int>")).otherwise(X.markers_used(F.col("text"), F.col("n_sources")))
    json = lambda c: F.to_json(c)
    rows = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("retrieval").alias("event"), json(F.struct((F.col("n_sources") == 0).alias("insufficient_context"))).alias("data")),
        F.struct(F.lit(2).alias("seq"), F.lit("token").alias("event"), json(F.struct(said.alias("text"))).alias("data")),
        F.struct(F.lit(3).alias("seq"), F.lit("done").alias("event"), json(F.struct(used.alias("citations_used"))).alias("data")),
    )
    return answers.select("conv_id", "turn", F.explode(rows).alias("e")).select("conv_id", "turn", "e.*")


def order_violations(events: DataFrame, by: tuple) -> DataFrame:
    """Per stream of events (seq, event): how often the order retrieval, token*, done or error is broken."""
    order = Window.partitionBy(*by).orderBy("seq")
    first = F.row_number().over(order) == 1
    after = F.lag("event").over(order)
    bad = F.when(first, F.col("event") != "retrieval").otherwise((F.col("event") == "retrieval") | after.isin("done", "error"))
    marked = events.withColumn("bad", bad.cast("int")).withColumn("ends", F.col("event").isin("done", "error").cast("int"))
    return marked.groupBy(*by).agg((F.sum("bad") + F.when(F.sum("ends") == 1, 0).otherwise(1)).alias("violations"))


def heartbeats(events: DataFrame, by: str, at: str, then: str, every: int = 15) -> DataFrame:
    """How many comment frames keep each stream open: one for every ``every`` idle seconds between its events, in order of ``at`` and ``then``."""
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at, then))
    idle = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("pings", F.coalesce(F.floor(idle / (every * 1_000_000)), F.lit(0)).cast("long"))


def fold(events: DataFrame, by: tuple) -> DataFrame:
    """The state a reader ends in: phase and text; a stream without an end is an error."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event", "data")))
    state = events.groupBy(*by).agg(ordered.alias("e"))
    text = F.array_join(F.transform(F.filter("e", lambda x: x["event"] == "token"), lambda x: F.get_json_object(x["data"], "$.text")), "")
    ends = F.filter("e", lambda x: x["event"].isin("done", "error"))
    phase = F.when(F.size(ends) == 0, "error").otherwise(F.try_element_at(ends, F.lit(-1))["event"])
    return state.select(*by, phase.alias("phase"), text.alias("text"))
