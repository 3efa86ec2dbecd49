"""Chat formatting by event-sourced reconstruction (native).

A log of events is folded into final messages and rendered with a template.
An event has ``conv_id, seq, message_id, event, role, text``:

* ``delta`` appends its text to the message (streamed output),
* ``edit`` replaces the text so far,
* ``regenerate`` drops the text so far (its own text, if any, starts the new one);
  any other or null event counts as ``delta``.

Events are grouped per message, sorted by ``seq``, and folded from the last
edit or regeneration on; a message stands where its first event stood.

Template: a turn is ``<s>[role]text</s>``.  In roles and texts ``&``, ``<``, ``[`` and
``]`` become ``&amp;``, ``&lt;``, ``&lb;`` and ``&rb;``, so no text can imitate a control
string, and the replacements undo each other exactly.  ``spans`` has, per turn,
the code-point offset and length of its (escaped) text in ``formatted`` and
whether it is under the loss mask (assistant turns).

Cases: null text counts as empty, null role as the empty role; null sequence
numbers sort first; events with equal keys are ordered by event, role and text;
a null conversation or message id is a group of its own; an empty log gives an
empty result; extra columns are not read.  A conversation is one value, as its
digest is; the fold itself is spread over messages, so a conversation with very
many events is not folded by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovecast.llm.common import materialize

__all__ = ["events_from_rows", "fold_messages", "format_chat", "read_back", "digests", "materialize"]

ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;")]
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def events_from_rows(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as a log: each row is one message
    made by one delta; rows of one turn stay apart, also when they are equal."""
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").cast("bigint").alias("seq"),
        F.concat_ws("#", F.coalesce(F.col("turn").cast("string"), F.lit("")), tie.cast("string")).alias("message_id"),
        F.lit("delta").alias("event"), "role", "text")


def fold_messages(events: DataFrame) -> DataFrame:
    """One row per final message: conv_id, position, message_id, role, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    event = F.struct(F.col("seq").cast("bigint").alias("seq"), F.coalesce("event", F.lit("delta")).alias("event"),
                     "role", text.alias("text"))
    got = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("ev"))
    # index of the last event that starts the text anew (0: none)
    start = F.array_max(F.transform("ev", lambda e, i: F.when(e["event"].isin("edit", "regenerate"), i + 1).otherwise(0)))
    kept = F.slice("ev", F.greatest(start, F.lit(1)), F.size("ev"))
    roles = F.filter(F.transform("ev", lambda e: e["role"]), lambda r: r.isNotNull())
    return got.select("conv_id", F.col("ev")[0]["seq"].alias("position"), "message_id",
                      F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"),
                      F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans."""
    turn = messages.select("conv_id", "position", "message_id", (F.col("role") == LOSS_ROLE).alias("loss"),
                           F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]")).alias("head"),
                           escape(F.col("text")).alias("body"))
    turn = turn.select("*", F.concat("head", "body", F.lit("</s>")).alias("out"))
    order = Window.partitionBy("conv_id").orderBy("position", F.length("message_id"), "message_id")
    before = F.coalesce(F.sum(F.length("out")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = turn.select("conv_id", "out", "loss", F.row_number().over(order).alias("i"),
                       (before + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("len"))
    one = turn.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "out", "start", "len", "loss"))).alias("t"))
    return one.select("conv_id", F.size("t").cast("bigint").alias("n_turns"),
                      F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
                      F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"),
                                                          x["loss"].alias("loss"))).alias("spans"))


def format_chat(events: DataFrame) -> DataFrame:
    """Fold an event log and render it (see the module text)."""
    return render(fold_messages(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns found in the formatted text: conv_id, i, role, text, loss_text
    (what the mask covers in this turn, unescaped; null where it covers none)."""
    parts = F.slice(F.split("formatted", r"<s>\["), 2, F.size("spans"))
    turn = formatted.select("conv_id", F.posexplode(F.arrays_zip(parts.alias("part"), F.col("spans").alias("span"))))
    turn = turn.select("conv_id", F.col("pos").alias("i"), F.col("col.part").alias("part"), F.col("col.span").alias("span"))
    order = Window.partitionBy("conv_id").orderBy("i")
    # offset of this turn's first character after its opening mark
    end = F.sum(F.length("part") + 4).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = end - F.length("part")
    role = F.substring_index("part", "]", 1)
    body = F.expr("substring(part, length(substring_index(part, ']', 1)) + 2)")
    masked = F.col("part").substr((F.col("span.start") - first + 1).cast("int"), F.col("span.len").cast("int"))
    return turn.select("conv_id", "i", unescape(role).alias("role"),
                       unescape(body.substr(F.lit(1), F.length(body) - 4)).alias("text"),
                       F.when(F.col("span.loss"), unescape(masked)).alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: what is read back from the formatted text, digested."""
    got = read_back(formatted).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("i", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t"),
                                             "loss_text"))).alias("turns"))
    loss = F.array_join(F.transform("turns", lambda x: F.coalesce(x["loss_text"], F.lit(""))), "")
    out = got.select("conv_id", "n_turns",
                     F.sha2(F.array_join(F.transform("turns", lambda x: x["t"]), ""), 256).alias("turns_sha256"),
                     F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"))
    sizes = formatted.select(F.col("conv_id").alias("_c"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return (out.join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")))
            .select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))
