"""Chat formatting by event sourcing, in DataFrame functions only.

A log holds events of conversations. Partitioned by conversation and sorted by sequence, they fold into final
messages: `open` starts a message, `delta` appends streamed text to it, `edit` replaces its text, `regenerate` drops
what was streamed so far. The messages are then rendered by a template that marks turns; control strings inside texts
are escaped reversibly, and the rendered assistant texts are the loss mask.

Events first meet by message, deltas are joined there; a conversation is gathered only as the one row it is rendered
to. A log that one conversation dominates thus costs no more than that conversation's own output.

Defined results: null text is empty, a null role is the empty role; events with equal sequence fold by kind, then
text; a message without `open` is the empty role's; repeated `open` events keep the first; an empty log gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: What a text must not pass on unescaped: the template's own marks and those of common templates (fixed values).
CONTROL = r"<\|turn\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>"


def escape(text: Column) -> Column:
    """Backslashes are doubled; a control string gets one after its first character and so stops being one."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(<|\[)(?=(?:\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>))", r"$1\\")


def unescape(text: Column) -> Column:
    """Undoes escape(): a doubled backslash becomes one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    # a line break is \\n after an even number of backslashes, which are doubled ones
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def log_of_messages(rows: DataFrame) -> DataFrame:
    """An event log that streams (conv_id, turn, role, text) rows: each opens a message and comes in two deltas."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = said.withColumns({"message": F.row_number().over(order).cast("bigint")})
    half = (F.length("text") / 2).cast("int")
    event = lambda k, kind, role, text: F.struct((F.col("message") * 3 + k).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    events = F.array(event(0, "open", F.col("role"), none), event(1, "delta", none, F.col("text").substr(F.lit(1), half)), event(2, "delta", none, F.col("text").substr(half + 1, F.length("text"))))
    return said.select("conv_id", "message", F.inline(events))


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, message, seq, kind, role, text)."""
    of_message = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(of_message)
    rank = F.when(F.col("kind") == "open", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    live = log.select("conv_id", "message", "seq", "kind", "role", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(said).alias("text"), rank.alias("rank"), reset.alias("reset"))
    counts = F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))
    part = F.struct("seq", "rank", "text")
    folded = live.groupBy("conv_id", "message").agg(
        F.min(F.when((F.col("kind") == "open") & F.col("role").isNotNull(), F.struct("seq", "role"))).alias("opened"),
        F.sort_array(F.collect_list(F.when(counts, part))).alias("parts"),
    )
    return folded.select("conv_id", "message", F.coalesce(F.col("opened.role").cast("string"), F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, and loss: (start, length) in code points of each assistant text in formatted."""
    head = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n"))
    piece = messages.select("conv_id", "message", (F.col("role") == "assistant").alias("learnt"), head.alias("head"), escape(F.col("text")).alias("body"))
    piece = piece.withColumns({"size": F.length("head") + F.length("body") + len(CLOSE)})
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")})
    turn = F.struct("message", F.concat("head", "body", F.lit(CLOSE)).alias("text"), "learnt", "start", F.length("body").alias("length"))
    whole = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    masked = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].cast("bigint").alias("start"), t["length"].cast("bigint").alias("length")))
    return whole.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), masked.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What rendered conversations say: turns (role, text) and the texts under the loss mask, unescaped."""
    pieces = F.split("formatted", r"<\|end\|>")
    said = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, F.length(piece))
        at = F.instr(body, "\n")
        return F.struct(_role_in(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))

    learnt = F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": F.transform(said, turn), "learnt": learnt})


def format_log(log: DataFrame) -> DataFrame:
    """A log's conversations, rendered."""
    return render(fold(log))
