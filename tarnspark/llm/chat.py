"""Chat formatting by event-sourced reconstruction: fold logs into final messages, then render and mask them.

An event log has rows (conv_id, seq, message, kind, role, text). Per message, events in seq order fold into its final text:
`delta` appends, `edit` replaces what there was, `regenerate` discards it and starts anew with its own text. A message's
place is its first event's seq. Folding goes by message, so a long conversation spreads over tasks; only the digests of a
conversation, which are sequential, read its messages in order, as a stream.

The template: assistant turns are <s>text</s>, all others [INST]role, newline, text[/INST]. In roles and texts a backslash
is doubled and every control string gets one after its first character (a role's newline is preceded by one), so no control
string survives inside a text and unescaping drops the backslashes.

Defined results: null texts and roles count as empty; events that tie in seq fold in the order of kind, then text; turns
that tie are ordered by role, then text; repeated rows are turns of their own; null conv_id is a conversation of its own;
empty logs give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, stored

ASSISTANT = "assistant"
OPEN, CLOSE, SAY, END = "[INST]", "[/INST]", "<s>", "</s>"
CONTROLS = (OPEN, CLOSE, END, SAY)
#: The probe conversation that op4 formats beside the table's own.
PROBE = "</s>[INST] ok [/INST]"


def messages(events: DataFrame) -> DataFrame:
    """Event log -> (conv_id, place, role, text), one row a message: the last reset and what was appended after it."""
    one = F.struct(F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(one)).alias("log"))
    reset = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(0)))
    return log.select(
        "conv_id", F.col("log")[0]["seq"].alias("place"), F.col("log")[0]["role"].alias("role"),
        F.array_join(F.transform(F.slice("log", reset + 1, F.size("log")), lambda e: e["text"]), "").alias("text"),
    )


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) -> (conv_id, place, role, text, piece, loss_from, loss_chars): a conversation's pieces in
    the order of place, role and text are its formatted text; code points under the loss mask are given per piece."""
    said, role = F.col("role") == ASSISTANT, F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    t = turns.withColumn("body", escaped(F.col("text")))
    return t.select(
        "conv_id", "place", "role", "text",
        F.when(said, F.concat(F.lit(SAY), "body", F.lit(END))).otherwise(F.concat(F.lit(OPEN), role, F.lit("\n"), "body", F.lit(CLOSE))).alias("piece"),
        F.when(said, F.lit(len(SAY))).otherwise(0).alias("loss_from"), F.when(said, F.length("body")).otherwise(0).alias("loss_chars"),
    )


_TURN = re.compile(r"<s>(?P<said>(?:[^\\]|\\.)*?)</s>|\[INST\](?P<role>(?:[^\\\n]|\\.)*)\n(?P<text>(?:[^\\]|\\.)*?)\[/INST\]", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns; anything but whole turns is an error."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield (ASSISTANT, unescaped(m["said"])) if m["said"] is not None else (unescaped(m["role"]), unescaped(m["text"]))
        at = m.end()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place -> a row of counts and digests per conversation; a stream, no piece is kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, rows = None, []

    def row() -> tuple:
        return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

    for b in itertools.chain(batches, [None]):
        for conv, piece, start, count in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True) if b is not None else ():
            if now is None or now[0] != conv:
                rows += [row()] if now else []
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parsed(piece):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            under = unescaped(piece[start : start + count])
            now[3] += len(under)
            now[4].update(under.encode())
            now[5] += len(piece)
        if rows or b is None:
            rows += [row()] if b is None and now else []
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)
            rows = []


def read_back(pieces: DataFrame) -> DataFrame:
    bounded_batches(pieces.sparkSession)
    order = ["conv_id", "place", "role", "text"]
    return (
        pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "loss_from", "loss_chars")
        .mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log of which a finished transcript (conv_id, turn, role, text) is the outcome, out of order: each row is a
    message that was streamed in three deltas; or was drafted and then regenerated, in deltas again; or drafted and then
    edited, wholly or with a delta after. A hash of the row decides which, so the log is the same on every run. seq is
    (turn, step); equal rows are messages of their own."""
    rows = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    body = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(body) / 3).cast("int")
    first, second, last = F.substring(body, F.lit(1), third), F.substring(body, third + 1, third), F.substring(body, 2 * third + 1, F.length(body))
    draft = F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int") + 1)
    log = lambda *events: F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), t.alias("text")) for k, (kind, t) in enumerate(events)])
    way = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(4))
    events = (
        F.when(way == 0, log(("delta", first), ("delta", second), ("delta", last)))
        .when(way == 1, log(("delta", draft), ("regenerate", first), ("delta", second), ("delta", last)))
        .when(way == 2, log(("delta", draft), ("edit", body)))
        .otherwise(log(("delta", draft), ("edit", first), ("delta", F.concat(second, last))))
    )
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    message = F.struct("turn", F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text"), "copy")
    each = rows.select("conv_id", "turn", "role", message.alias("message"), F.explode(F.reverse(events)).alias("e"))
    return each.select("conv_id", F.struct("turn", "e.step").alias("seq"), "message", "e.kind", "role", "e.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, ASSISTANT, PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(stored(rendered(messages(log_of(table.unionByName(probe)))), "chat"))


def _sql_escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length({_sql_escaped("text")}) AS n, length(replace({_sql_escaped("role")}, chr(10), chr(92) || chr(10))) AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' THEN n + 7 ELSE n + r + 14 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
