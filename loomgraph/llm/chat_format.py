"""Chat formatting by event sourcing: logs are partitioned by conversation, sorted by sequence and
folded into final messages, which are then rendered with a loss mask. DataFrame functions only.

An event is (conv_id, seq, kind, target, role, text). Kinds:

* message: begins a message; messages of a conversation are numbered from 1 in order of sequence.
* delta: appends text to message `target` (null: the latest message that survives at that point).
* edit: replaces the text of message `target`; earlier deltas of it no longer count.
* regenerate: as edit, and drops every message after `target` that had begun by then.

The fold takes one exchange on conv_id; all that follows reuses its partitioning. Sorting spills to
disk; only a conversation's own log and rendered string have to fit in memory, as the latter is one
output value. Work is in proportion to a conversation's events but for sorting, and for regenerations
that go back behind the last message: each of those looks at those of them that are still in force.

Defined cases: null roles and texts are empty; ties of seq go by kind, role, text and target; an
event of another kind, or without a surviving message to refer to, is dropped; repeated rows are
events of their own; rows with a null conv_id form one conversation; an empty log gives no rows;
other columns are ignored.

The template writes a turn as `<s>[role]text</s>`. Inside roles and texts the characters of control
strings are escaped reversibly, so no text can close its own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<s>[", "]", "</s>"

#: Fixed values of the template: what is escaped, in this order; reading goes backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished turns as events: one message each."""
    return conversations.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").cast("bigint").alias("seq"),
        F.lit("message").alias("kind"),
        F.lit(None).cast("bigint").alias("target"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def _in_force(cuts: Column) -> Column:
    """Of regenerations that go back behind the last message, (at, target, begun) in order, the places
    of those whose target survives until then. `begun` counts the messages begun by then.

    The fold keeps those in force that no later one covers: their targets and places both rise, so a
    message is gone if the last of them with a smaller target came after it had begun."""
    none = F.array().cast("array<struct<target:bigint,begun:bigint>>")
    last = lambda xs: F.get(xs, F.size(xs) - 1)

    def step(held: Column, cut: Column) -> Column:
        over = F.when(
            F.coalesce(last(held["stack"])["target"] < cut["target"], F.lit(True)), held["stack"]
        ).otherwise(F.filter(held["stack"], lambda c: c["target"] < cut["target"]))
        gone = F.coalesce(last(over)["begun"] >= cut["target"], F.lit(False))
        own = F.array(F.struct(cut["target"].alias("target"), cut["begun"].alias("begun")))
        return F.when(gone, held).otherwise(
            F.struct(F.concat(over, own).alias("stack"), F.concat(held["places"], F.array(cut["at"])).alias("places"))
        )

    start = F.struct(none.alias("stack"), F.array().cast("array<bigint>").alias("places"))
    return F.aggregate(cuts, start, step, lambda held: held["places"])


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_no, role, text) of each conversation."""
    order = W.partitionBy("conv_id").orderBy("seq", "kind", "role", "text", "target")
    is_message = F.col("kind") == "message"
    known = events.where(F.col("kind").isin("message", "delta", "edit", "regenerate")).select(
        "conv_id",
        "kind",
        F.col("target").cast("bigint").alias("target"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.row_number().over(order).cast("bigint").alias("at"),
        F.sum(is_message.cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("begun"),
    )
    cut = F.when(
        (F.col("kind") == "regenerate") & F.col("target").between(F.lit(1), F.col("begun") - 1), F.struct("at", "target", "begun")
    )
    logs = known.groupBy("conv_id").agg(
        F.collect_list(F.struct("at", "kind", "target", "begun", "role", "text")).alias("log"),
        _in_force(F.array_sort(F.collect_list(cut))).alias("in_force"),
    )
    leads = lambda x: F.when(x["kind"] == "message", x["begun"]).when(
        (x["kind"] == "regenerate") & F.array_contains("in_force", x["at"]), x["target"]
    )
    # In the generator, so that no event's row carries what its whole conversation has in force.
    rows = logs.select("conv_id", F.inline(F.transform("log", lambda x: F.struct(
        *(x[c].alias(c) for c in ("at", "kind", "target", "role", "text")), leads(x).alias("leads")
    ))))
    latest = F.last("leads", ignorenulls=True).over(
        W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    )
    e = rows.select("*", F.when(is_message, F.col("leads")).otherwise(F.coalesce("target", latest)).alias("message_no"))
    messages = (
        e.groupBy("conv_id", "message_no")
        .agg(
            F.min(F.when(is_message, F.struct("at", "role"))).alias("first"),
            F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("since"),
            F.max(F.when(~is_message & F.col("leads").isNotNull(), F.col("at"))).alias("cut_after"),
            F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"),
        )
        .where(F.col("first").isNotNull())
    )
    earlier = W.partitionBy("conv_id").orderBy("message_no").rowsBetween(W.unboundedPreceding, -1)
    return (
        messages.withColumn("cut", F.max("cut_after").over(earlier))
        .where(F.col("cut").isNull() | (F.col("first.at") > F.col("cut")))
        .select(
            "conv_id",
            "message_no",
            F.col("first.role").alias("role"),
            F.array_join(
                F.transform(F.filter("parts", lambda p: p["at"] >= F.col("since")), lambda p: p["text"]), ""
            ).alias("text"),
        )
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: formatted text and the spans (start, length) under the loss.

    Spans count code points of `formatted` and cover the escaped texts of loss_role, nothing else.
    """
    before = W.partitionBy("conv_id").orderBy("message_no").rowsBetween(W.unboundedPreceding, -1)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    pieces = messages.select("conv_id", "message_no", "role", head.alias("head"), body.alias("body"))
    length = (F.length("head") + F.length("body") + len(CLOSE)).cast("bigint")
    pieces = pieces.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct(
        "message_no",
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.when(
            F.col("role") == loss_role,
            F.struct(F.col("start").alias("start"), F.length("body").cast("bigint").alias("length")),
        ).alias("span"),
    )
    return (
        pieces.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
            F.array_compact(F.transform("turns", lambda t: t["span"])).alias("loss_spans"),
        )
    )


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans of finished conversations (conv_id, turn, role, text)."""
    return render(fold_events(as_events(conversations)), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the text under the loss, both read from what render() wrote.

    Pieces and spans are sorted by where they start, so each span is read from the piece it lies in
    and no span searches the whole text. Rows with an equal conv_id are read each; a null or empty
    text has no turns; spans outside every piece give nothing."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), ROLE_END, 1)
        return F.struct(
            unescape(role).alias("role"),
            unescape(F.substr(piece, F.lit(len(OPEN) + len(ROLE_END) + 1) + F.length(role))).alias("text"),
        )

    row = lambda k, piece, start, size: F.struct(
        k.cast("bigint").alias("k"), piece.cast("string").alias("piece"), start.cast("bigint").alias("start"), size.cast("bigint").alias("size")
    )
    none = F.lit(None)
    pieces = F.transform(
        F.filter(F.split(F.coalesce("formatted", F.lit("")), CLOSE), lambda p: p != ""),
        lambda p, k: row(k, p, none, F.length(p) + len(CLOSE)),
    )
    spans = F.transform(F.coalesce("loss_spans", F.array().cast("array<struct<start:bigint,length:bigint>>")), lambda s: row(none, none, s["start"], s["length"]))
    # The whole text goes along once, not with each of its parts.
    whole = F.struct(F.lit(-1).cast("bigint").alias("k"), F.col("formatted").alias("piece"), F.lit(-1).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("size"))
    parts = formatted.select(
        "conv_id", F.monotonically_increasing_id().alias("_row"), "formatted", "loss_spans"
    ).select("conv_id", "_row", F.inline(F.concat(F.array(whole), pieces, spans)))
    own = W.partitionBy("conv_id", "_row")
    before = own.orderBy(F.col("k").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce("start", F.sum("size").over(before)))
    last_piece = F.last(F.when(F.col("k") >= 0, F.struct("piece", "start")), ignorenulls=True).over(
        own.orderBy("start", F.col("k").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    )
    read = placed.select("*", F.when(F.col("k").isNull(), last_piece).alias("under"))
    told = F.substr(F.col("under.piece"), (F.col("start") - F.col("under.start") + 1).cast("int"), F.col("size").cast("int"))
    found = read.groupBy("conv_id", "_row").agg(
        # A maximum would copy the whole text for each row.
        F.get(F.collect_list(F.when(F.col("k") == -1, F.col("piece"))), 0).alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", turn(F.col("piece")).alias("turn"))))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("under").isNotNull(), F.struct("start", unescape(told).alias("text"))))).alias("told"),
    )
    return found.select(
        "conv_id",
        "formatted",
        F.transform("turns", lambda t: t["turn"]).alias("turns"),
        F.array_join(F.transform("told", lambda t: t["text"]), "").alias("loss_text"),
    )
