"""Chat formatting: folds an event log into messages and renders them, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import staged

HEAD, HEAD_END, TURN_END = "### ", ":\n", "</turn>\n"
EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


def escape(text: Column) -> Column:
    """Backslashes are doubled, then `</turn>` and every # after two is preceded by one; see unescape."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), "(?<=##)#", r"\\#")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    """The inverse: whatever follows a backslash stands for itself."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages that stand at the end of the log.

    Events of a conversation apply by seq, those of equal seq with resets before deltas and then by
    text. `message` sets a turn's text, `delta` appends to it, `edit` sets it and drops what later
    turns had before, `regenerate` clears the turn (its own text, if any, is the beginning) and drops
    what later turns had. A null kind is a message, a null seq is the earliest, a null text is empty;
    null conv_id and null turn are values like any other. Repeated deltas append twice. A turn's role
    is the last one given. Text outside a standing turn is gone; a turn all of whose events were
    dropped is not returned. Deltas are folded for each turn first, so a long conversation spreads
    over tasks until its messages are put in order.
    """
    kind, seq = F.coalesce("kind", F.lit("message")), F.coalesce("seq", F.lit(-(1 << 63)))
    log = events.select("conv_id", "turn", seq.alias("seq"), (kind == "delta").alias("appends"), kind.isin("edit", "regenerate").alias("forks"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(~F.col("appends"), F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("forks"), F.col("seq"))).alias("fork"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.sort_array(F.collect_list(F.struct("seq", "appends", "text"))).alias("parts"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    cut = turns.withColumn("cut", F.max("fork").over(earlier))
    last = F.struct(F.col("reset").alias("seq"), F.lit(False).alias("appends"))
    after = lambda p: F.col("cut").isNull() | (p["seq"] > F.col("cut"))
    standing = cut.withColumn("parts", F.filter("parts", after)).where(F.size("parts") > 0)
    # Of several resets with one seq the last by text counts.
    from_reset = F.filter("parts", lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    resets = F.filter(from_reset, lambda p: ~p["appends"])
    texts = F.concat(F.transform(F.slice(F.reverse(resets), 1, 1), lambda p: p["text"]), F.transform(F.filter(from_reset, lambda p: p["appends"]), lambda p: p["text"]))
    return standing.select("conv_id", "turn", "role", F.array_join(texts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation, null conv_id and turn being
    values like any other. Null texts and roles are empty ones; messages of one turn go in order of their text; an empty input gives an empty result. Only the four columns
    conv_id, turn, role and text of the input are looked at.

    A turn is `### role:`, its text and `</turn>`, each with a line break as in the constants; control
    strings inside texts and roles are escaped. loss_spans are starts (from 0) and lengths in code
    points of the assistant's escaped texts in `formatted`.
    """
    head = F.concat(F.lit(HEAD), escape_role("role"), F.lit(HEAD_END))
    made = messages.select("conv_id", "turn", "role", head.alias("head"), escape("text").alias("body"))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length(F.concat("head", "body")) + len(TURN_END)
    start = F.coalesce(F.sum(size.cast("long")).over(so_far), F.lit(0)) + F.char_length("head")
    placed = made.withColumn("start", start)
    segment = F.struct("turn", F.concat("head", "body", F.lit(TURN_END)).alias("segment"), F.when(F.col("role") == "assistant", F.struct("start", F.char_length("body").cast("long").alias("length"))).alias("span"))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment)).alias("turns"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["segment"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["span"].isNotNull()), lambda x: x["span"]).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text) of the turns in rendered conversations, unescaped;
    loss_text is what the loss mask covers of the turn, null where it covers nothing."""
    blocks = F.split("formatted", TURN_END, -1)
    cut = rendered.select("conv_id", F.posexplode(F.slice(blocks, 1, F.size(blocks) - 1)).alias("turn", "block"))
    head = F.char_length(F.regexp_extract("block", r"(?s)^### (?:[^\\\n]|\\.)*+\n", 0))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum((F.char_length("block") + len(TURN_END)).cast("long")).over(so_far), F.lit(0))
    turns = cut.withColumn("head", head).withColumn("at", before + F.col("head"))
    spans = rendered.select(F.col("conv_id").alias("span_conv"), F.inline("loss_spans"))
    joined = turns.join(spans, F.col("conv_id").eqNullSafe(F.col("span_conv")) & (F.col("at") == F.col("start")), "left")
    role = F.expr(f"substring(block, {len(HEAD) + 1}, head - {len(HEAD) + len(HEAD_END)})")
    return joined.select("conv_id", "turn", unescape(role).alias("role"), unescape(F.expr("substring(block, head + 1)")).alias("text"), unescape(F.expr("substring(block, head + 1, cast(length as int))")).alias("loss_text"))


def as_events(conversations: DataFrame, piece: int = 512, draft: int = 64) -> DataFrame:
    """The log of a table of rows (conv_id, turn, role, text) by turn: rows of one turn go by role and
    text. An assistant first streams a draft of other words, is asked to regenerate, and then sends its
    text in deltas of `piece` code points. Anyone else sends the beginning of a text and then edits
    the message to be the whole. Folded, the log gives the table's texts again: null as empty, an
    empty table as an empty log. Other columns of the input are not looked at."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.row_number().over(order).cast("long"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    begun = F.left("text", F.lit(draft))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.char_length("text") / piece).cast("int")), lambda i: event("delta", F.when(i == 0, "").otherwise(F.substr("text", (i - 1) * piece + 1, F.lit(piece)))))
    streamed = F.concat(F.array(event("message", F.lit("")), event("delta", F.reverse(begun)), event("regenerate", F.lit(""))), pieces)
    edited = F.array(event("message", begun), event("edit", F.col("text")))
    log = rows.withColumn("events", F.when(F.col("role") == "assistant", streamed).otherwise(edited))
    return log.select("conv_id", "place", "role", F.posexplode("events").alias("k", "event")).select("conv_id", (F.col("place") * (1 << 32) + F.col("k")).alias("seq"), "event.kind", F.col("place").alias("turn"), "role", "event.text")


def digests(conversations: DataFrame) -> DataFrame:
    """The query's columns, read back from the rendered conversations, which are written once: the log
    is folded a single time, and a lost executor costs only its share."""
    rendered = staged(render(fold(as_events(conversations))), "chat-rendered")
    turn = F.struct("turn", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("shown"), F.coalesce("loss_text", F.lit("")).alias("loss"))
    read = read_back(rendered).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    joined = lambda field: F.array_join(F.transform("turns", lambda x: x[field]), "")
    texts = read.select("conv_id", "n_turns", joined("shown").alias("shown"), joined("loss").alias("loss"))
    sizes = rendered.select(F.col("conv_id").alias("sized"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return texts.join(sizes, F.col("conv_id").eqNullSafe(F.col("sized"))).select(
        "conv_id", "n_turns", F.sha2(F.col("shown").cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )
