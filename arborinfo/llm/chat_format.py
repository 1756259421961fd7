r"""Chat formatting from event logs, with DataFrame functions only.

A log has the columns conv_id, seq, kind, turn, role and text. The events of a conversation, in order
of ``seq``, build its messages:

* ``message`` begins the message of a turn with a role and a text, or begins it anew;
* ``delta`` appends its text to the message of its turn, as a stream does;
* ``edit`` replaces the text of a turn by its own, the following turns stay;
* ``regenerate`` empties a turn and drops all later turns; deltas then fill it again.

Logs are dealt by conversation and sorted by sequence once. An event counts if no later event undoes
it: no regeneration of its own or an earlier turn, no later message or edit of its turn. Both are
windows that read each row once and spill, so the fold needs no list of a conversation's events. What
counts is joined to one text a turn, the turns are rendered and joined to one row a conversation.

Template: a conversation is ``<s>``, then for each turn ``[INST]role\ntext[/INST]``, or ``text</s>``
for the assistant. Inside texts and roles, each control string gets one backslash after its first
character, behind those that are there, so ``</s>`` becomes ``<\/s>`` and ``<\/s>`` becomes ``<\\/s>``;
taking one away again restores every text. In roles a line feed is ``\n``, a backslash ``\\``. No control
string begins inside another one, so a text can never complete one with what follows it.

The loss mask lists the spans of assistant texts, without their end mark, in code points and in bytes.

Defined cases: a null text, delta or role is empty; a null or unknown kind is a message. A missing turn
comes before all others and is one turn; so does a missing seq, before all other events. Events of equal
seq are taken by turn, kind (regenerate, message, edit, delta), role and text; an event that repeats
another one in all columns is a redelivery and counts once. The role of a turn is that of its last event
that has one. Rows without conv_id belong to no common conversation: each is one of its own. An empty log
gives no rows; other columns are ignored. A conversation is one row of the result and must fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ASSISTANT = "assistant"
KINDS = ("regenerate", "message", "edit", "delta")


def escape(text: Column) -> Column:
    """``text`` with one more backslash in each control string."""
    return F.regexp_replace(text, r"(<\\*)(/?s>)|(\[\\*)(/?INST\])", r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"(<\\*)\\(/?s>)|(\[\\*)\\(/?INST\])", r"$1$3$2$4")


def escape_role(role: Column) -> Column:
    """A role on one line: percent signs and line feeds as ``%25`` and ``%0A``."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def known_kind(kind: Column) -> Column:
    return F.when(kind.isin(*KINDS), kind).otherwise("message")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of all conversations that have an id."""
    log = events.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "seq", "turn", F.array_position(F.lit(list(KINDS)), known_kind(F.col("kind"))).alias("rank"),
        "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    event = F.struct("seq", "turn", "rank", "role", "text")
    newest_first = [F.desc_nulls_last(c) for c in ("seq", "turn", "rank", "role", "text")]
    in_log = Window.partitionBy("conv_id").orderBy(*newest_first)
    in_turn = Window.partitionBy("conv_id", "turn").orderBy(*newest_first)
    later = (Window.unboundedPreceding, -1)
    rank = {kind: k + 1 for k, kind in enumerate(KINDS)}
    place = F.struct("turn")  # a struct, so that a missing turn is ordered too
    marked = log.select(
        "*",
        F.min(F.when(F.col("rank") == rank["regenerate"], place)).over(in_log.rowsBetween(*later)).alias("cut"),
        F.lag(event).over(in_log).alias("next"),
    ).select(
        "*",
        F.max(F.col("rank").isin(rank["message"], rank["edit"])).over(in_turn.rowsBetween(*later)).alias("replaced"),
    )
    undone = (
        F.coalesce(F.col("cut") <= place, F.lit(False)) | F.coalesce("replaced", F.lit(False))
        | F.coalesce(F.col("next") == event, F.lit(False)) | F.col("next").eqNullSafe(event)
    )
    counting = F.when(~undone, F.struct("seq", "rank", "role", "text"))
    turns = marked.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(counting)).alias("parts"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "rank", "role", "text"))).alias("role"),
    )
    return turns.where(F.size("parts") > 0).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join("parts.text", "").alias("text")
    )


def rendered(messages: DataFrame) -> DataFrame:
    """``messages`` with the text of each in the template, and whether it is an assistant's."""
    text = escape(F.col("text"))
    plain = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), text, F.lit(CLOSE))
    return messages.withColumn("answers", F.col("role") == ASSISTANT).withColumn(
        "piece", F.when(F.col("answers"), F.concat(text, F.lit(END))).otherwise(plain)
    )


def spans(chars_before: Column, bytes_before: Column) -> Column:
    """The span of an assistant's text whose piece has so much text before it."""
    n, size = F.char_length("piece") - len(END), F.octet_length("piece") - len(END)
    return F.when(
        F.col("answers"),
        F.struct(
            chars_before.alias("begin"), (chars_before + n).alias("end"),
            bytes_before.alias("byte_begin"), (bytes_before + size).alias("byte_end"),
        ),
    )


def format_events(events: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of every conversation of the log."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda size: F.lit(len(BEGIN)).cast("long") + F.coalesce(F.sum(size).over(before), F.lit(0))
    placed = rendered(fold_events(events)).select(
        "conv_id", "turn", "answers", "piece",
        ahead(F.char_length("piece")).alias("chars"), ahead(F.octet_length("piece")).alias("bytes"),
    ).select("conv_id", "turn", "piece", spans(F.col("chars"), F.col("bytes")).alias("span"))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "piece", "span"))).alias("turns")
    )
    lone = events.where(F.col("conv_id").isNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    begin = F.lit(len(BEGIN)).cast("long")
    single = rendered(lone).select(
        "conv_id", F.array(F.struct("turn", "piece", spans(begin, begin).alias("span"))).alias("turns")
    )
    return whole.unionByName(single).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join("turns.piece", "")).alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: structs of role and text."""
    pieces = F.regexp_extract_all(
        F.substring(formatted, len(BEGIN) + 1, F.char_length(formatted)),
        F.lit(r"(?s)\[INST\].*?\[/INST\]|.*?</s>"), F.lit(0),
    )

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(OPEN) + 1, F.char_length(piece) - len(OPEN) - len(CLOSE))
        role = F.substring_index(inner, "\n", 1)
        rest = F.substring(inner, F.char_length(role) + 2, F.char_length(inner))
        answer = F.substring(piece, F.lit(1), F.char_length(piece) - len(END))
        opens = F.startswith(piece, F.lit(OPEN))
        return F.struct(
            F.when(opens, unescape_role(role)).otherwise(ASSISTANT).alias("role"),
            unescape(F.when(opens, rest).otherwise(answer)).alias("text"),
        )

    return F.transform(pieces, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (structs of role and text) and loss_text, read from the text and its mask."""
    with_bytes = formatted.withColumn("_bytes", F.encode("formatted", "UTF-8"))
    piece = lambda s: F.substring(
        F.col("_bytes"), (s["byte_begin"] + 1).cast("int"), (s["byte_end"] - s["byte_begin"]).cast("int")
    )
    under = F.transform("loss_spans", lambda s: unescape(piece(s).cast("string")))
    return with_bytes.withColumns({
        "turns": parsed(F.col("formatted")),
        "loss_text": F.when(F.octet_length("_bytes") > 0, F.array_join(under, "")),
    }).drop("_bytes")


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations, rows (conv_id, turn, role, text).

    Turns are numbered by turn, role and text, each row is one. Answers come as a stream: an empty
    message, then one delta a line.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.where(F.col("conv_id").isNotNull()).withColumn("turn", F.row_number().over(order).cast("long"))
    lines = F.concat(F.array(F.lit("")), F.split("text", r"(?<=\n)"))
    parts = F.when(F.col("role") == ASSISTANT, lines).otherwise(F.array("text"))
    streamed = numbered.select("conv_id", "turn", "role", F.posexplode(parts).alias("part", "text"))
    alone = rows.where(F.col("conv_id").isNull()).select(
        "conv_id", F.col("turn").cast("long"), "role", F.lit(0).alias("part"), "text"
    )
    return streamed.unionByName(alone).select(
        "conv_id", F.struct("turn", "part").alias("seq"),
        F.when(F.col("part") == 0, "message").otherwise("delta").alias("kind"), "turn", "role", "text",
    )
