"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A conversation arrives as a log of events. ``fold`` partitions the log by conversation
and message, sorts by sequence number and folds streamed deltas, edits and
regenerations into final messages; ``render`` lays the messages out under a template
with a loss mask; ``read_back`` parses the rendered text again.

Cases: a null text is empty, a null role is the empty role. Events with equal sequence
numbers fold in the order of kind, role and text. Repeated ``message`` events each
open a message, so repeated rows stay repeated. A delta, edit or regeneration with no
message before it opens one. Null conversation ids form a conversation of their own.
An empty log gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.bind import let

#: Code points of a draft that as_events() streams and has replaced.
DRAFT = 16
#: Control strings of the template. Texts can't hold them once escaped, see escape().
START, END = "<|im_start|>", "<|im_end|>"

MESSAGES = "array<struct<role:string,text:string>>"


def escape(text: Column, role: bool = False) -> Column:
    r"""Make control strings harmless, reversibly.

    Backslashes are doubled, then ``<|`` becomes ``<\|``. A lone backslash between ``<``
    and ``|`` can only come from here, for all others stand in runs of even length. In a
    role a line feed, which ends it, becomes ``<\n>``, told apart the same way.
    """
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(text, F.lit("\n"), F.lit("<\\n>")) if role else text


def unescape(text: Column, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit("<\\n>"), F.lit("\n"))
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """events: conv_id, msg (order of messages), seq, kind, role, text, and perhaps row -> conv_id, messages array<struct<role,text>>.

    kind: ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces its
    text, ``regenerate`` discards its text so that later deltas stream a new one. ``row``
    tells messages of equal msg apart; such messages stand in the order of role and text.

    The log is dealt by conversation once. Within a task messages are gathered and folded
    apart from each other, and finished messages meet in their conversation, whose
    rendered form is one value anyhow. A fold is linear in its log: the last event that
    isn't a delta is found, and what comes from there on is joined.
    """
    e = events.select(
        "conv_id",
        "msg",
        F.col("row").alias("row") if "row" in events.columns else F.lit(0).alias("row"),
        F.struct(
            F.col("seq").alias("seq"),
            F.col("kind").alias("kind"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("e"),
    ).repartition("conv_id")

    def folded(log: Column) -> Column:
        """The message of a log that begins with its opening event."""
        since = F.coalesce(F.array_max(F.transform(log, lambda x, i: F.when(x.kind != "delta", i))), F.lit(0))
        parts = F.transform(F.slice(log, since + 1, F.size(log)), lambda x: F.when(x.kind == "regenerate", "").otherwise(x.text))
        return F.struct(F.get(log, F.lit(0)).role.alias("role"), F.array_join(parts, "").alias("text"))

    log = F.array_sort(F.collect_list("e")).alias("log")
    per = e.groupBy("conv_id", "msg", "row").agg(log)
    # where messages open: at message events, and at the log's start
    per = per.withColumn("opens", F.filter(F.transform("log", lambda x, i: F.when((x.kind == "message") | (i == 0), i)), lambda i: i.isNotNull()))
    spans = F.transform("opens", lambda i, k: let(F.slice("log", i + 1, F.coalesce(F.get("opens", k + 1), F.size("log")) - i), folded))
    per = per.select("conv_id", "msg", spans.alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("msg", "m")))
    return per.groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda x: x.m)).cast(MESSAGES).alias("messages"))


def as_events(log: DataFrame) -> DataFrame:
    """The events that stream the rows of a log: conv_id, turn, role, text -> conv_id, msg, row, seq, kind, role, text.

    Every message opens empty, streams the beginning of a draft, is regenerated, streams
    the draft again, is edited to the first half of its text, and streams the rest in two deltas.
    Events come out of order, as logs do; seq has their order.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    rest = F.length(text) - half
    second = F.floor(rest / 2).cast("int")
    draft = F.left(text, F.lit(DRAFT))
    stream = [
        (6, "delta", F.substr(text, half + second + 1)),
        (2, "regenerate", F.lit(None).cast("string")),
        (4, "edit", F.left(text, half)),
        (0, "message", F.lit("")),
        (3, "delta", draft),
        (5, "delta", F.substr(text, half + 1, second)),
        (1, "delta", draft),
    ]
    events = F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(kind).alias("kind"), t.alias("text")) for n, kind, t in stream])
    rows = log.select("conv_id", F.col("turn").alias("msg"), F.monotonically_increasing_id().alias("row"), "role", events.alias("events"))
    rows = rows.select("conv_id", "msg", "row", "role", F.explode("events").alias("x"))
    return rows.select("conv_id", "msg", "row", "x.seq", "x.kind", F.when(F.col("x.kind") == "message", F.col("role")).alias("role"), "x.text")


def render(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` to rows with ``messages``.

    loss_spans has one struct<turn, start, length> per message of ``trained_role``: the
    message's number, and where its escaped text lies in its turn (code points from 0;
    a turn is what follows its START).
    """

    def turn(m: Column) -> Column:
        return F.concat(F.lit(START), escape(m.role, role=True), F.lit("\n"), escape(m.text), F.lit(END + "\n"))

    numbered = F.transform(
        "messages",
        lambda m, i: F.struct(
            i.alias("turn"),
            (F.length(escape(m.role, role=True)) + 1).alias("start"),
            F.length(escape(m.text)).alias("length"),
            (m.role == trained_role).alias("trained"),
        ),
    )
    spans = F.transform(
        F.filter(numbered, lambda s: s.trained),
        lambda s: F.struct(s.turn.alias("turn"), s.start.alias("start"), s.length.alias("length")),
    )
    return conversations.select(
        "conv_id", F.array_join(F.transform("messages", turn), "").alias("formatted"), spans.alias("loss_spans")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse rendered rows: conv_id, messages as rendered, and loss_texts, the unescaped text under each loss span."""
    pieces = F.transform(
        F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p, i: i > 0), lambda p: F.substring_index(p, END, 1)
    )
    parsed = F.transform(
        "turns",
        lambda t: F.struct(
            unescape(F.substring_index(t, "\n", 1), role=True).alias("role"),
            unescape(F.substr(t, F.instr(t, "\n") + F.lit(1))).alias("text"),
        ),
    )
    loss = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr(F.get("turns", s.turn), s.start + F.lit(1), s.length)),
    )
    return rendered.withColumn("turns", pieces).select(
        "conv_id", parsed.alias("messages"), loss.alias("loss_texts"), "formatted"
    )


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and digests of what read_back() finds."""
    back = read_back(rendered)
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
