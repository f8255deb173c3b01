"""Citation markers in answers that arrive in pieces."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Fixed value: a bracket left open is held back up to this many characters.
LONGEST_TAIL = 32
#: Where the scan is: outside brackets, before a number, in one, behind one, or in a bracket that can be no marker.
OUTSIDE, BEFORE, NUMBER, BEHIND, BROKEN = range(5)
DIGIT, COMMA, BLANK, CLOSE = range(4)
#: What follows on each state inside a bracket, by the kind of character.
NEXT = {
    BEFORE: {DIGIT: NUMBER, COMMA: BROKEN, BLANK: BEFORE},
    NUMBER: {DIGIT: NUMBER, COMMA: BEFORE, BLANK: BEHIND},
    BEHIND: {DIGIT: BROKEN, COMMA: BEFORE, BLANK: BEHIND},
    BROKEN: {DIGIT: BROKEN, COMMA: BROKEN, BLANK: BROKEN},
}


def kind_of(c: str) -> int | None:
    return DIGIT if c.isdecimal() else COMMA if c == "," else CLOSE if c == "]" else BLANK if c.isspace() else None


def scan(text: str, sources: int) -> tuple[str, str, set[int]]:
    """One pass over a text: what is safe to show, the bracket left open at its end, the sources cited.

    A marker's numbers within 1..sources stay, one bracket each; all else is as it was.
    """
    shown: list[str] = []
    cited: set[int] = set()
    state, start = OUTSIDE, 0
    numbers: list[str] = []
    for k, c in enumerate(text):
        if c == "[":
            shown.append(text[start:k])
            state, start, numbers = BEFORE, k, [""]
            continue
        if state == OUTSIDE:
            continue
        kind = kind_of(c)
        if kind == CLOSE and state in (NUMBER, BEHIND):
            known = [n for n in map(int, numbers) if 1 <= n <= sources]
            cited.update(known)
            shown += [f"[{n}]" for n in known]
            state, start = OUTSIDE, k + 1
        elif kind is None or kind == CLOSE:
            state = OUTSIDE
        else:
            state = NEXT[state][kind]
            if kind == DIGIT:
                numbers[-1] += c
            elif kind == COMMA:
                numbers.append("")
    if state == OUTSIDE or len(text) - start > LONGEST_TAIL:
        return "".join(shown) + text[start:], "", cited
    return "".join(shown), text[start:], cited


def filter_deltas(deltas: DataFrame) -> DataFrame:
    """Whole streams (conv_id, seq, delta, n_sources) as text and used markers.

    A stream's pieces are joined in order of seq and the text rewritten at once by
    ``valid_markers``; a bracket left open at the end goes, if it is no longer than what a
    stream would hold back.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "")
    whole = deltas.groupBy("conv_id").agg(joined.alias("text"), F.first("n_sources").alias("n_sources"))
    kept = F.regexp_replace(F.col("text"), rf"\[[0-9,\s]{{0,{LONGEST_TAIL - 1}}}\z", "")
    return whole.select("conv_id", X.valid_markers(kept, F.col("n_sources")).alias("text"), X.markers_used(kept, F.col("n_sources")).alias("used"))


def filter_pieces(deltas: DataFrame) -> DataFrame:
    """The same piece by piece, each scanned with the bracket that the ones before it left open, as a stream does it."""

    def run(key, rows):
        held, shown, cited = "", [], set()
        for delta, sources in rows.sort_values("seq")[["delta", "n_sources"]].itertuples(index=False):
            text, held, new = scan(held + delta, int(sources))
            shown.append(text)
            cited |= new
        return pd.DataFrame({"conv_id": [key[0]], "text": ["".join(shown)], "used": [sorted(cited)]})

    return deltas.groupBy("conv_id").applyInPandas(run, "conv_id bigint, text string, used array<int>")


def in_turn(expected: int, waiting: dict, arrived: list[tuple], flush: bool) -> tuple[list[tuple], int]:
    """The pieces (seq, ...) that can be shown now, and which is expected then; those that came too early stay in ``waiting``.

    A piece that comes twice counts once. With ``flush`` gaps are passed over.
    """
    waiting |= {p[0]: p for p in arrived if p[0] >= expected and p[0] not in waiting}
    ready = []
    while expected in waiting or flush and waiting:
        expected = expected if expected in waiting else min(waiting)
        ready.append(waiting.pop(expected))
        expected += 1
    return ready, expected


def filter_stream(deltas: DataFrame, idle: str | None = "10 minutes") -> DataFrame:
    """The same on a streaming DataFrame (conv_id, seq, delta, n_sources, last): emits the safe text of each batch.

    Pieces are numbered from 0; one that comes early, even by batches, waits for those before
    it. State is the open bracket, the used markers and what waits of each conversation. It
    goes with the last delta, or when none has come for ``idle``: then what waits is shown,
    what was held back is dropped, as at an end, and the conversation is reported as done.
    Queries that are to end by themselves (trigger availableNow) take None, as a time-out
    keeps a query awake.
    """
    from pyspark.sql.streaming.state import GroupState

    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def run(key, parts, state: GroupState):
        held, used, expected, early = state.get if state.exists else ("", "", 0, "[]")
        cited, shown, ended = {int(n) for n in used.split()}, [], state.hasTimedOut
        waiting = {p[0]: tuple(p) for p in json.loads(early)}
        arrived = [] if ended else [(int(s), d, int(n), bool(e)) for p in parts for s, d, n, e in p[["seq", "delta", "n_sources", "last"]].itertuples(index=False)]
        ready, expected = in_turn(expected, waiting, arrived, ended)
        for _, delta, sources, last in ready:
            text, held, new = scan(held + delta, sources)
            shown.append(text)
            cited |= new
            ended = ended or last
        if ended:
            state.remove()
        else:
            state.update((held, " ".join(map(str, sorted(cited))), expected, json.dumps(sorted(waiting.values()))))
            if wait:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame({"conv_id": [key[0]], "text": ["".join(shown)], "used": [sorted(cited)], "done": [ended]})

    kept = "held string, used string, expected bigint, early string"
    return deltas.groupBy("conv_id").applyInPandasWithState(run, "conv_id bigint, text string, used array<int>, done boolean", kept, "append", "ProcessingTimeTimeout" if wait else "NoTimeout")
