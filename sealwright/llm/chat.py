"""Chat formatting from event logs, with DataFrame functions only.

A log row is an event of a conversation: ``message`` begins a message, ``delta`` appends streamed text to the latest
message of its turn, ``edit`` replaces that message's text and ``regenerate`` empties it for the deltas that follow.
Events are folded turn by turn (a delta, edit or regeneration without a message begins one with its text), turns are put
in order, and conversations are rendered by a template. The fold is linear in the events of a turn: a message is the text
of the last event that sets it, followed by the deltas after that.

The template marks each turn and escapes control strings inside roles and texts by a backslash after their first
character (and backslashes by doubling), so a text can neither end its turn nor start another, and unescaping gives
back exactly what went in. ``segments`` are the pieces of the output with the loss mask: text of assistant turns is
under the mask, markup and other turns are not.

Null texts are empty, null roles too; null sequence numbers and turns come first; ties are put in order by role and
text, and repeated rows are repeated messages. A null conversation id is a conversation of its own. An empty table
gives an empty result. Extra columns are ignored. A conversation is one output row, so its texts meet in one task;
they are partly gathered before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings: the template's own, and those of other common templates and tokenizers.
CONTROLS = (OPEN, SEP, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: First character, rest: any control string.
_CONTROL = r"(<)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|(\[)(/?INST\])"


def escape(x: Column) -> Column:
    doubled = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1$3\\$2$4")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def messages(log: DataFrame, conv: str = "conv_id", turn: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, messages): the final messages of each turn, from its events in order of their sequence numbers."""
    blank = F.lit("")
    event = F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"))
    events = log.groupBy(F.col(conv).alias("conv"), F.col(turn).alias("turn")).agg(F.sort_array(F.collect_list(event)).alias("events"))
    message = "struct<role:string,text:string>"
    # where messages begin, and one place past the last event
    begins = F.filter(F.sequence(F.lit(1), F.size("events")), lambda i: (i == 1) | (F.element_at("events", i)["kind"] == "message"))
    events = events.select("conv", "turn", "events", F.concat(begins, F.array(F.size("events") + 1)).alias("begins"))

    def fold(at: Column, n: Column) -> Column:
        own = F.slice("events", at, F.element_at("begins", n + 2) - at)
        # the last event that sets the text: the first one, an edit or a regeneration
        sets = F.array_max(F.transform(own, lambda e, i: F.when((i == 0) | e["kind"].isin("edit", "regenerate"), i + 1)))
        base = own[sets - 1]
        set_to = F.when((base["kind"] == "regenerate") & (sets > 1), blank).otherwise(base["text"])
        deltas = F.array_join(F.transform(F.slice(own, sets + 1, F.size(own)), lambda e: F.when(e["kind"] == "delta", e["text"]).otherwise(blank)), "")
        return F.struct(own[0]["role"].alias("role"), F.concat(set_to, deltas).alias("text")).cast(message)

    one = F.size("events") == 1  # the common case needs no fold
    first = F.array(F.struct(F.col("events")[0]["role"].alias("role"), F.col("events")[0]["text"].alias("text")).cast(message))
    folded = F.transform(F.slice("begins", 1, F.size("begins") - 1), fold)
    return events.select("conv", "turn", F.when(one, first).otherwise(folded).alias("messages"))


def render(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, segments) from the turns that :func:`messages` makes."""
    whole = turns.groupBy("conv").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "messages"))), lambda t: t["messages"])).alias("messages"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def parts(m: Column) -> Column:
        no = F.lit(False)
        return F.array(piece(F.concat(F.lit(OPEN), escape(m["role"]), F.lit(SEP)), no), piece(escape(m["text"]), m["role"] == loss_role), piece(F.lit(CLOSE + "\n"), no))

    out = whole.select("conv", F.flatten(F.transform("messages", parts)).alias("segments"))
    return out.select("conv", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    marked = F.split(formatted, "<\\|im_start\\|>")

    def back(t: Column) -> Column:
        role = F.substring_index(t, SEP, 1)
        text = F.substring_index(F.substring_index(t, CLOSE, 1), SEP, -1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), back)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def format_chats(log: DataFrame, **columns: str) -> DataFrame:
    return render(messages(log, **columns))
