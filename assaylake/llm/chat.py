"""Chat formatting whose output a deterministic parser reads back to the same turns.

A turn is rendered as ``### Label: body`` and the line ``</turn>``. Rendered text is parsed by one rule: a line ``</turn>``
ends a turn, its label runs to the first colon, and in the body one backslash goes from before each control string
(``### `` or ``</turn>``). Each turn is first rendered as it is and parsed again; one that comes back otherwise is rendered
with a backslash more before each control string. This always comes back: control strings overlap neither one another nor
a backslash, so the parser takes away what was put in, and no line ``</turn>`` is left in a body. Turns end where they end
alone, as a label begins with ``#``; so a conversation is the concatenation of its turns, and is parsed and compared once
more as a whole before it is written.

The output has the text and its loss mask, the spans of assistant bodies in bytes of UTF-8, so that a span is cut
without walking over the text before it. Only SQL functions run.

Scale: one shuffle of the turns by conversation, in which places and offsets are running counts and the text is gathered.
A conversation is one string, as a text of ``documents`` is; nothing else is gathered.

Defined cases: a null text is empty, a null role is the empty role; the roles system, user, assistant and tool have labels
of their own, any other is written as ``@`` and its URL encoding; turns are in the order of turn (null first), role and
text, and rows that repeat are turns each; a row with a null conv_id is a conversation of its own; texts of any length are
rendered whole; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import shared_folder

#: Labels of the roles that have one; any other role is encoded.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "\n</turn>\n"
CONTROL = r"(### |</turn>)"
HEADER = rf"^### ({'|'.join(LABELS.values())}|@[A-Za-z0-9.*_+%-]*): "

OUTPUT = "conv_id long, formatted string, loss array<struct<start:int,bytes:int>>"


def header(role: Column) -> Column:
    label = F.concat(F.lit("@"), F.url_encode(role))
    for name, known in LABELS.items():
        label = F.when(role == name, known).otherwise(label)
    return F.concat(F.lit("### "), label, F.lit(": "))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(body: Column) -> Column:
    return F.regexp_replace(body, r"\\" + CONTROL, "$1")


def parsed(formatted: Column) -> Column:
    """The turns, as structs of role and text, that the parser reads from rendered text."""
    known = lambda label: reduce(lambda other, x: F.when(label == x[1], x[0]).otherwise(other), LABELS.items(), F.url_decode(F.substring(label, 2, 1 << 30)))

    def turn(piece: Column) -> Column:
        start = F.regexp_extract(piece, HEADER, 0)
        body = F.substring(piece, F.length(start) + 1, F.lit((1 << 31) - 1))
        whole = F.when(start != "", known(F.regexp_extract(piece, HEADER, 1)))  # null where there is no turn
        return F.struct(whole.alias("role"), unescaped(body).alias("text"))

    pieces = F.split(formatted, END, -1)  # what follows the last turn is empty
    rest = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.transform(rest, turn)


def rendered(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text) with head and body as they are written."""
    plain = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    same = lambda body: parsed(F.concat("head", body, F.lit(END))) == source
    return plain.withColumn("head", header(F.col("role"))).withColumn("body", F.when(same(F.col("text")), F.col("text")).otherwise(escaped(F.col("text"))))


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss. Fails where a whole conversation doesn't parse to its turns."""
    rows = rendered(turns).withColumn("size", F.octet_length("head") + F.octet_length("body") + len(END))
    order = "partition by conv_id order by turn, role, text rows between unbounded preceding and current row"
    placed = rows.filter("conv_id is not null").select("*", F.expr(f"count(1) over ({order})").alias("place"), F.expr(f"sum(size) over ({order}) - size").alias("at"))
    span = F.struct((F.col("at") + F.octet_length("head")).cast("int").alias("start"), F.octet_length("body").alias("bytes"))
    loss = F.when(F.col("role") == "assistant", span)
    entry = lambda place: F.struct(place.alias("place"), "role", "text", F.concat("head", "body", F.lit(END)).alias("written"), loss.alias("loss"))
    many = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry(F.col("place")))).alias("turns"))
    alone = rows.filter("conv_id is null").withColumn("at", F.lit(0)).select("conv_id", F.array(entry(F.lit(1).cast("long"))).alias("turns"))
    whole = many.unionByName(alone).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("source"), F.array_join("turns.written", "").alias("formatted"), F.array_compact("turns.loss").alias("loss"))
    checked = F.when(parsed(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string"))
    return whole.select("conv_id", checked.alias("formatted"), "loss")


def write_conversations(turns: DataFrame, folder: str) -> None:
    conversations_of(turns).write.parquet(folder)


def read_turns(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turns (role, text), the text under the loss mask unescaped, in order, and the length of what is written."""
    rows = spark.read.schema(OUTPUT.replace("formatted string", "formatted binary")).parquet(folder)
    span = lambda s: unescaped(F.decode(F.substring("formatted", s["start"] + 1, s["bytes"]), "UTF-8"))
    text = F.decode("formatted", "UTF-8")
    return rows.select("conv_id", parsed(text).alias("turns"), F.array_join(F.transform("loss", span), "").alias("loss_text"), F.length(text).cast("long").alias("formatted_chars"))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_turns(spark, folder).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_conflict(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts say what the template says."""
    text = r"\### Assistant: </turn> ok"
    rows = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(rows)


def format_round_trip(turns: DataFrame) -> DataFrame:
    """Writes the formatted conversations to the shared folder and returns their digests as read back."""
    folder = shared_folder(turns.sparkSession, "chat")
    write_conversations(turns, folder)
    return read_digests(turns.sparkSession, folder)


ORACLE_SQL = r"""
with rows_ as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows_
), b as (
  select *, case when regexp_matches(text, '\\(### |</turn>)') or contains(text || chr(10), chr(10) || '</turn>' || chr(10))
    then regexp_replace(text, '(### |</turn>)', '\\\1', 'g') else text end as body from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || role || ': ') + length(body) + 9) as bigint) as formatted_chars
from b group by conv_id
"""
