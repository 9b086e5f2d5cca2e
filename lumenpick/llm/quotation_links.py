"""Chat formatting: quotation linking, in DataFrame operations only.

Messages quote by leading '>' signs, one per level.  Per message, without a
shuffle, the lines are parsed into runs of one level.  A run of level 0 is the
message's own text, every other run a quoted passage.  Passages and own texts
are normalised (case, white space) and hashed, as a whole and per paragraph, and
passages join the earliest message that has the same unit: in the
conversation before the quoting message, or else anywhere.  The original
holder of a unit is found by a minimum per hash, so a text that opens thousands of
conversations gives one row and no pairs.

A message replies to the message that its first-level passages link to
inside the conversation.  In reply order every message follows the one it answers, with all
replies to a message before its next sibling; positions and depths come from pointer doubling.  The
conversations are then built in that order, without the quotes.

Defined results: null texts have no own text and no quotes; messages without a linked quote
are roots; null conv_id or turn link with nothing, have no position and are in no built
conversation.  Repeated rows give one result row each and share a position.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import Scratch

#: Positions that one row of a built conversation spans.
PART_MESSAGES = 1000

_MARKS = r"^(?:[ \t]*>)+"
_BLANKS = r"[ \t\n\r\f\u000B]+"
_PARAGRAPH = r"\n[ \t\r]*\n"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, _BLANKS, " ")))


def _units(text: Column) -> Column:
    """The whole text and its paragraphs, normalised and hashed; which of them is the whole."""
    parts = F.concat(F.array(text), F.split(text, _PARAGRAPH))
    parts = F.filter(F.array_distinct(F.transform(parts, normalised)), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(F.md5(x).alias("unit"), (i == 0).alias("whole")))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """Adds `content`, the own text, and `quotes`: an array of (level, text) of the quoted passages in order."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", "")).alias("level"),
            F.regexp_replace(F.regexp_replace(line, _MARKS, ""), r"^ ", "").alias("body"),
        ),
    )
    parsed = messages.withColumn("_lines", lines)
    last = F.size("_lines") - 1
    parsed = parsed.withColumn(
        "_starts",
        F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("_lines", i)["level"] != F.get("_lines", F.greatest(i - 1, F.lit(0)))["level"])),
    )
    runs = F.transform(
        "_starts",
        lambda start, k: F.struct(
            F.get("_lines", start)["level"].alias("level"),
            F.array_join(
                F.transform(F.slice("_lines", start + 1, F.coalesce(F.get("_starts", k + 1), last + 1) - start), lambda x: x["body"]), "\n"
            ).alias("text"),
        ),
    )
    parsed = parsed.withColumn("_runs", runs)
    own = F.array_join(F.transform(F.filter("_runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    return parsed.select(
        *messages.columns,
        F.trim(F.regexp_replace(own, r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("content"),
        F.filter("_runs", lambda r: r["level"] > 0).alias("quotes"),
    )


def _doubled(nodes: DataFrame, pointer: str, merge: Callable[[DataFrame], DataFrame], unfinished: str, scratch: Scratch) -> DataFrame:
    """Pointer doubling over rows (conv_id, turn, pointer, ...): unfinished rows meet the row they point to (columns t_...) until none is left.

    A row never holds more than its pointer and a number, so chains of any length need memory in proportion.
    """
    current = scratch.keep(nodes)
    while not current.filter(unfinished).isEmpty():
        rest = [c for c in current.columns if c not in ("conv_id", "turn")]
        target = current.select("conv_id", F.col("turn").alias(pointer), *[F.col(c).alias(f"t_{c}") for c in rest])
        moved = merge(current.filter(unfinished).join(target, ["conv_id", pointer])).select(*current.columns)
        previous, current = current, scratch.keep(current.filter(f"not ({unfinished})").unionByName(moved))
        scratch.drop(previous)
    return current


def reply_order(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, depth, position (from 1) of messages in reply order, from (conv_id, turn, parent_turn) with parents before their replies.

    Every message is followed by its first reply, or else by the next reply to the nearest message above it that has
    one.  Those successors form a list, and positions are distances from its end.
    """
    nodes = scratch.keep(numbered(parents, "conv_id", F.asc_nulls_first("parent_turn"), "turn"))
    following = nodes.select((F.col("number") - 1).alias("number"), F.col("conv_id").alias("c"), F.col("parent_turn").alias("p"), F.col("turn").alias("next_turn"))
    sibling = (F.col("conv_id") == F.col("c")) & F.col("parent_turn").eqNullSafe(F.col("p"))
    nodes = scratch.keep(nodes.join(following, "number", "left").select("conv_id", "turn", "parent_turn", F.when(sibling, F.col("next_turn")).alias("sibling")))

    depths = _doubled(
        nodes.select("conv_id", "turn", F.col("parent_turn").alias("above"), F.col("parent_turn").isNotNull().cast("int").alias("depth")), "above",
        lambda r: r.withColumns({"above": F.col("t_above"), "depth": F.col("depth") + F.col("t_depth")}), "above is not null", scratch,
    )
    # up: the nearest message at or above with a next sibling
    has_next = F.col("sibling").isNotNull()
    ups = _doubled(
        nodes.select("conv_id", "turn", F.when(has_next, F.col("turn")).otherwise(F.col("parent_turn")).alias("up"), (has_next | F.col("parent_turn").isNull()).alias("done")), "up",
        lambda r: r.withColumns({"up": F.col("t_up"), "done": F.col("t_done")}), "not done", scratch,
    )
    firsts = nodes.filter("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("first_reply"))
    siblings = nodes.filter(has_next).select("conv_id", F.col("turn").alias("up"), F.col("sibling").alias("beside"))
    after = ups.select("conv_id", "turn", "up").join(firsts, ["conv_id", "turn"], "left").join(siblings, ["conv_id", "up"], "left")
    after = after.select("conv_id", "turn", F.coalesce("first_reply", "beside").alias("after"))
    places = _doubled(
        after.withColumn("behind", F.col("after").isNotNull().cast("long")), "after",
        lambda r: r.withColumns({"after": F.col("t_after"), "behind": F.col("behind") + F.col("t_behind")}), "after is not null", scratch,
    )
    sizes = nodes.groupBy("conv_id").agg(F.count("*").alias("size"))
    out = places.join(sizes, "conv_id").select("conv_id", "turn", (F.col("size") - F.col("behind")).alias("position"))
    return scratch.keep(out.join(depths.select("conv_id", "turn", "depth"), ["conv_id", "turn"]))


def linked_messages(messages: DataFrame) -> DataFrame:
    """One row per message row: conv_id, turn, role, content, parent_conv_id, parent_turn, depth, position, n_quotes, n_linked."""
    scratch = Scratch(messages.sparkSession)
    base = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    parsed = scratch.keep(parsed_messages(base).drop("text"))

    units = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(_units(F.col("content"))).alias("u")).select("conv_id", "turn", "u.unit")
    here = scratch.keep(units.groupBy("conv_id", "unit").agg(F.min("turn").alias("first_turn")))
    anywhere = here.groupBy("unit").agg(F.min(F.struct("conv_id", "first_turn")).alias("first"))
    anywhere = scratch.keep(anywhere.select("unit", F.col("first.conv_id").alias("any_conv"), F.col("first.first_turn").alias("any_turn")))

    passages = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("quotes").alias("place", "quote"))
    passages = passages.select("conv_id", "turn", "place", "quote.level", F.explode(_units(F.col("quote.text"))).alias("u")).select("conv_id", "turn", "place", "level", "u.*").distinct()
    passages = scratch.keep(passages)
    inside = scratch.keep(passages.join(here, ["conv_id", "unit"], "left").withColumn("inside", F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn"))).drop("first_turn"))
    found = inside.join(anywhere, "unit", "left").withColumn(
        "outside", F.when(F.col("inside").isNull() & (F.col("any_conv") != F.col("conv_id")), F.struct("any_conv", "any_turn"))
    )
    found = found.filter("inside is not null or outside is not null").select(
        "conv_id", "turn", "place",
        F.struct(
            F.col("inside").isNotNull().alias("near"), (F.col("level") == 1).alias("direct"), "whole",
            F.coalesce("inside", "outside.any_turn").alias("turn"), F.coalesce(F.when(F.col("inside").isNotNull(), F.col("conv_id")), F.col("outside.any_conv")).alias("conv_id"),
        ).alias("target"),
    )
    links = found.groupBy("conv_id", "turn").agg(
        F.countDistinct("place").alias("n_linked"), F.max(F.when(F.col("target.direct"), F.col("target"))).alias("target")
    )
    links = scratch.keep(links)
    own_parent = F.when(F.col("target.near"), F.col("target.turn"))
    nodes = parsed.select("conv_id", "turn").distinct().join(links, ["conv_id", "turn"], "left").select("conv_id", "turn", own_parent.alias("parent_turn"))
    order = reply_order(nodes.filter("conv_id is not null and turn is not null"), scratch)
    out = parsed.join(links, ["conv_id", "turn"], "left").join(order, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "content", F.col("target.conv_id").alias("parent_conv_id"), F.col("target.turn").alias("parent_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "position", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def conversations(linked: DataFrame) -> DataFrame:
    """The conversations without quotes: conv_id, part, messages (role, content) in reply order, chat (formatted text).

    A part holds the messages of PART_MESSAGES positions, so that a conversation of any length is built in bounded rows.
    Messages without own text, or without a place in a conversation, are left out.
    """
    placed = linked.filter("content <> '' and position is not null")
    ordered = F.sort_array(F.collect_list(F.struct("position", "role", "content")))
    grouped = placed.groupBy("conv_id", part_of("position").alias("part")).agg(ordered.alias("m"))
    turn = lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), x["content"], F.lit("\n"))
    return grouped.select("conv_id", "part", F.transform("m", lambda x: F.struct(x["role"], x["content"])).alias("messages"), F.array_join(F.transform("m", turn), "").alias("chat"))


def part_of(position: str) -> Column:
    return F.floor((F.col(position) - 1) / PART_MESSAGES).cast("long")


def conversation_digest(messages: DataFrame) -> DataFrame:
    """linked_messages with the MD5 of each content and of the part of the built conversation that has its place (null without a place or a built part)."""
    linked = Scratch(messages.sparkSession).keep(linked_messages(messages))
    built = conversations(linked).select("conv_id", "part", F.md5("chat").alias("chat_md5"))
    rows = linked.withColumn("part", part_of("position")).join(built, ["conv_id", "part"], "left")
    return rows.select(*[c for c in linked.columns if c != "content"], F.md5("content").alias("content_md5"), "part", "chat_md5")


def as_mail_threads(conversations: DataFrame, levels: int = 2) -> DataFrame:
    """Turns as mails: each quotes the turn before it, and that one's quotes, down to `levels` levels."""
    threads = conversations.select("conv_id", "turn", "role", "text")
    before = conversations.filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("_before"))
    prefix = F.lit("")
    for back in range(1, levels + 1):
        shifted = before.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("_before").alias(f"_before{back}"))
        threads = threads.join(shifted, ["conv_id", "turn"], "left")
        mark = "> " * back
        quoted = F.concat(F.lit(mark), F.replace(F.col(f"_before{back}"), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
        prefix = F.concat(F.coalesce(quoted, F.lit("")), prefix)
    return threads.select("conv_id", "turn", "role", F.concat(prefix, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
