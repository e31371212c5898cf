"""Chat formatting: quoted passages linked to the messages they come from, in DataFrame functions only.

A line's quote level is the number of `>` before its text; consecutive lines of one level are a passage.
Passages are normalised (lower case, letters and digits) and hashed as a whole, by line, by sentence and by
windows of WINDOW words, so that other line breaks and excerpts still meet. The hashes of quoted passages
are joined to those of the unquoted passages of all earlier turns of the conversation, one row for each
hash and turn. A message replies to the earlier turn that most hashes of its outermost quotes come from
(the later one on ties); every quote level has such a source of its own. Roots and depths follow by pointer
doubling. Messages come back without quotes, with the keys that put a conversation in reply order, each reply
with all that replies to it before the next one: root_turn, position.

Positions are ranks in a tour of each tree that enters and leaves every message. The tour's next steps come
from first children and next siblings, its ranks from pointer doubling, so a thread of any depth or width
takes a logarithm of its size in joins and no thread is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.storage import cut, through_table


WINDOW = 6
#: Turns of a range in which next siblings are found; ranges are then tied to one another.
SIBLINGS = 1 << 16
_PASSAGE, _LEVEL = "\ue000", "\ue001"


def _normal(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' '))"


def _hashes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, k): the hashes of each message's passages by level, and in how many passages each is."""
    text = f"translate(coalesce(text, ''), '{_PASSAGE}{_LEVEL}', '')"
    marked = rf"transform(split({text}, '\n'), x -> struct(regexp_extract(x, '^((?:[ \\t]*>)*)[ \\t]?', 0) as mark, x as line))"
    levels = "transform(m, x -> struct(length(regexp_replace(x.mark, '[^>]', '')) as level, substring(x.line, length(x.mark) + 1) as body))"
    joined = rf"array_join(transform(m, (x, i) -> concat(if(i = 0 or x.level <> get(m, i - 1).level, concat('{_PASSAGE}', x.level, '{_LEVEL}'), '\n'), x.body)), '')"
    rows = messages.select("conv_id", "turn", F.expr(marked).alias("m")).withColumn("m", F.expr(levels)).withColumn("m", F.expr(joined))
    rows = rows.select("conv_id", "turn", F.posexplode(F.split("m", _PASSAGE)).alias("at", "p")).where("p <> ''")
    rows = rows.select("conv_id", "turn", "at", F.expr(f"cast(substring_index(p, '{_LEVEL}', 1) as int)").alias("level"), F.expr(f"substring_index(p, '{_LEVEL}', -1)").alias("p"))
    whole = rows.withColumn("whole", F.expr(_normal("p"))).where("whole <> ''").withColumn("words", F.split("whole", " "))
    parts = rf"concat(array(whole), transform(concat(split(p, '\n'), split(p, '(?<=[.!?])\\s+')), x -> {_normal('x')}))"
    windows = f"transform(if(size(words) >= {WINDOW}, sequence(0, size(words) - {WINDOW}), cast(array() as array<int>)), i -> xxhash64(slice(words, i + 1, {WINDOW})))"
    every = f"array_distinct(concat(transform(filter({parts}, x -> x <> ''), x -> xxhash64(x)), {windows}))"
    return whole.select("conv_id", "turn", "level", F.explode(F.expr(every)).alias("h")).groupBy("conv_id", "turn", "level", "h").agg(F.count(F.lit(1)).alias("k"))


def _positions(parent: DataFrame) -> DataFrame:
    """(conv_id, turn, position): the place of each message of a tree (conv_id, turn, parent_turn) in reply order, from 0."""
    family = ["conv_id", "parent_turn"]
    ranged = parent.withColumn("range", F.expr(f"turn div {SIBLINGS}"))
    near = F.lead("turn").over(Window.partitionBy(*family, "range").orderBy("turn"))
    heads = ranged.groupBy(*family, "range").agg(F.min("turn").alias("head")).withColumn("after", F.lead("head").over(Window.partitionBy(*family).orderBy("range")))
    sibling = ranged.withColumn("near", near).join(heads, [*family, "range"]).select("conv_id", "turn", "parent_turn", F.coalesce("near", "after").alias("sibling"))
    nodes = parent.select("conv_id", "turn").union(parent.select("conv_id", F.col("parent_turn"))).distinct()
    child = parent.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    both = nodes.join(child, ["conv_id", "turn"], "left").join(sibling, ["conv_id", "turn"], "left")
    enter = F.struct(F.lit(0).alias("side"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("n"))
    leave = F.struct(F.lit(1).alias("side"), F.coalesce("sibling", "parent_turn").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("n"))
    state = both.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "turn", "x.*")
    while True:
        # Messages entered from a step of the tour to its end.
        step = state.select("conv_id", F.col("turn").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("next"), F.col("to_side").alias("next_side"), F.col("n").alias("more"))
        joined = cut(state.join(step, ["conv_id", "to", "to_side"], "left"))
        state = joined.select("conv_id", "turn", "side", F.col("next").alias("to"), F.coalesce("next_side", F.lit(1)).alias("to_side"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        if joined.where("next is not null").isEmpty():
            break
    return state.where("side = 0").select("conv_id", "turn", "n")


def reply_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), max_level, parent_turn, root_turn, depth, position, sources per message.

    A conversation in reply order is sorted by root_turn and position. sources gives the earlier turn that each
    quote level comes from. Messages without a resolved quote are roots (parent_turn null, depth and position 0). Null or empty texts quote
    nothing; a null conv_id or turn is never linked; rows that repeat a (conv_id, turn) share their links
    and are all returned; other columns are ignored; an empty table gives an empty result.
    """
    messages = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    known = messages.where("conv_id is not null and turn is not null")
    quoted = through_table(_hashes(known.where(r"text rlike '(^|\n)[ \\t]*>'")).where("level > 0"), "quotes")
    # Only conversations with quotes, up to the last message that holds one.
    last = quoted.groupBy("conv_id").agg(F.max("turn").alias("last"))
    earlier = known.join(last, "conv_id").where("turn < last").select("conv_id", "turn", "text")
    holders = _hashes(earlier).where("level = 0").select("conv_id", "h", F.col("turn").alias("source"))
    hits = quoted.join(holders, ["conv_id", "h"]).where("source < turn").groupBy("conv_id", "turn", "level", "source").agg(F.sum("k").alias("k"))
    # The outermost level comes first, then the most hashes, then the later turn.
    parent = hits.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "k", "source")).getField("source").alias("parent_turn"))
    parent = through_table(parent, "parents")
    best = hits.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("k", "source")).getField("source").alias("source"))
    sources = best.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("level", F.col("source").alias("turn")))).alias("sources"))
    state = parent.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("steps"))
    while True:
        jump = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        joined = cut(state.join(jump, ["conv_id", "up"], "left"))
        state = joined.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if joined.where("next is not null").isEmpty():
            break
    links = parent.join(state, ["conv_id", "turn"]).join(sources, ["conv_id", "turn"])
    if not parent.isEmpty():
        from_here = cut(_positions(parent))
        whole = from_here.select("conv_id", F.col("turn").alias("up"), F.col("n").alias("whole"))
        links = links.join(from_here, ["conv_id", "turn"]).join(whole, ["conv_id", "up"]).withColumn("position", F.col("whole") - F.col("n")).drop("n", "whole")
    else:
        links = links.withColumn("position", F.lit(0).cast("long"))
    bare = F.expr(r"array_join(filter(split(text, '\n'), x -> not x rlike '^[ \\t]*>'), '\n')")
    levels = F.expr(r"array_max(transform(split(coalesce(text, ''), '\n'), x -> length(regexp_replace(regexp_extract(x, '^((?:[ \\t]*>)*)', 0), '[^>]', ''))))")
    return messages.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.trim(bare).alias("text"), levels.alias("max_level"), "parent_turn", F.coalesce("up", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0).cast("long")).alias("depth"),
        F.coalesce("position", F.lit(0).cast("long")).alias("position"), "sources",
    )
