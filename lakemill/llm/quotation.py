"""Quotation linking: quoted passages are joined to the messages that they come from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.keys import named
from lakemill.llm.ranking import sort_ranked
from lakemill.llm.storage import cut, drop

#: The mark of a quoted line, one for each level, and a line that introduces a quote.
QUOTED = re.compile(r"(?:[ \t]*>)+[ \t]?")
INTRODUCES = re.compile(r"\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|a écrit|escribió)\b", re.IGNORECASE)
BETWEEN_PARAGRAPHS = re.compile(r"\n[ \t]*\n")
BETWEEN_WORDS = re.compile(r"[\W_]+")
#: Turns of a conversation that a window runs over.
BUCKET_TURNS = 256
#: What a message's columns are called in here.
COLUMNS = ("conv", "turn", "role")


def key_of(passage: str) -> bytes | None:
    """A digest that passages of the same words share; none without words."""
    words = BETWEEN_WORDS.sub(" ", passage.lower()).strip()
    return hashlib.md5(words.encode()).digest() if words else None


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes, and its quoted passages as (level, lines).

    A line's level is the number of its leading ``>``, which spaces may part. A
    passage is a run of lines of one level. A line that introduces a quote goes
    with it.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = QUOTED.match(line)
        level = m[0].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            # up to a colon at its end, however far that is
            if not before and own and own[-1].rstrip().endswith(":") and INTRODUCES.match(own[-1]):
                own.pop()
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        before = level
    return ("\n".join(own).strip() if passages else text), passages


def units(own: str) -> list[bytes]:
    """Digests of what others may quote of a text: the whole, its paragraphs and its lines."""
    parts = [own, *BETWEEN_PARAGRAPHS.split(own), *own.split("\n")]
    return list(dict.fromkeys(k for k in map(key_of, parts) if k))


def quotes_of(lines: list[str]) -> list[tuple[int, str]]:
    """What is looked up of a quoted passage, as (part, words): 0 the whole, 1 its paragraphs of several lines, 2 its lines."""
    whole = "\n".join(lines)
    paragraphs = [p for p in BETWEEN_PARAGRAPHS.split(whole) if "\n" in p.strip() and p != whole]
    return [(0, whole), *((1, p) for p in paragraphs), *((2, line) for line in lines if len(lines) > 1)]


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, own, quotes, units, n_quotes): each message parsed."""
    quote = pa.struct([("level", pa.int64()), ("place", pa.int64()), ("part", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, quotes, keys, passages = [], [], [], []
            for text in batch.column("text").to_pylist():
                own, found = parse(text) if text is not None else (None, [])
                clean.append(own)
                keys.append(units(own or ""))
                passages.append(len(found))
                rows = [(level, i, part, key_of(p)) for i, (level, lines) in enumerate(found) for part, p in quotes_of(lines)]
                quotes.append([dict(zip(("level", "place", "part", "key"), r, strict=True)) for r in rows if r[3]])
            made = [pa.array(clean, pa.string()), pa.array(quotes, pa.list_(quote)), pa.array(keys, pa.list_(pa.binary())), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), *made], [*COLUMNS, "own", "quotes", "units", "n_quotes"])

    rows = messages.select(*(named(old).alias(new) for old, new in zip((conv_col, turn_col, role_col), COLUMNS, strict=True)), named(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in COLUMNS)
    return rows.mapInArrow(run, f"{kinds}, own string, quotes array<struct<level: long, place: long, part: long, key: binary>>, units array<binary>, n_quotes long")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without quotes, in reply order, each with the message that it replies to.

    Quoted passages, whole, by paragraphs and line by line, are looked up by a digest of their
    words among the whole texts, paragraphs and lines that messages say
    themselves. A passage comes from the last earlier turn of its conversation
    that says it, or else from the first message of the only conversation that does, if that
    has a smaller id. What several conversations say identifies no original: such
    passages make no link between conversations and are counted instead. A message replies to the source of its least deeply
    quoted passage, of those of one level to the one found whole, then to one
    found by a paragraph of several lines, then to the first. A source precedes its reply, so that replies make trees.

    Returns, for each row: the conversation, turn and role; ``text`` without
    quotes; ``n_quotes`` (passages); ``n_common`` (of its wholes, paragraphs and lines those that no earlier turn of the
    conversation says, and several conversations do, the first of them with a smaller id); ``reply_conv`` and ``reply_turn`` (null if
    none); ``depth`` (replies above it); ``thread_conv`` (the conversation of the
    message at the top of its tree) and ``position``, its place from 0 in the
    conversation of that id, in which each message follows the one it replies to.

    Null texts stay null, have no quotes and say nothing; long ones are parsed whole. Messages whose
    conversation or turn is null have no links. Of rows with one conversation
    and turn, each takes part; links go to that turn, and they share the reply
    that is found first. Ties in position are ordered by text. Other columns are
    ignored, whatever their names; an empty table gives no rows.

    What is said often isn't paired with all that quote it: a digest has one
    source for each conversation's turn, found by a window that runs over :data:`BUCKET_TURNS`
    turns and is handed the last source of earlier ones, and one
    source over all, by map-side combined minima. Places come from ranges of sorted
    keys, so that neither a conversation nor a thread nor a turn with any number of rows has a task of its own.
    """
    base = cut(parsed(messages, conv_col, turn_col, role_col, text_col).withColumn("row", F.monotonically_increasing_id()), "messages")
    placed = base.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    quotes = cut(placed.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.*").distinct(), "quotes")
    said = placed.select("conv", "turn", F.explode("units").alias("key")).join(quotes.select("key").distinct(), "key", "left_semi").distinct()
    said = cut(said, "said")
    first = said.groupBy("key").agg(F.min(F.struct("conv", "turn")).alias("first"), F.max("conv").alias("last_conv"))
    bucket = F.floor(F.col("turn") / BUCKET_TURNS).alias("bucket")
    latest = said.groupBy("conv", "key", bucket).agg(F.max("turn").alias("latest"))
    before = Window.partitionBy("conv", "key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    both = quotes.select("*", bucket).unionByName(said.select("*", bucket, F.col("turn").alias("source")), allowMissingColumns=True)
    both = both.unionByName(latest.select("conv", "key", "bucket", F.col("latest").alias("source"), F.lit(True).alias("sums")), allowMissingColumns=True)
    # turns are unique to a conversation, so a source at the same turn is the message itself
    running = Window.partitionBy("conv", "key", "bucket").orderBy("turn", F.col("source").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.where("sums is null").withColumn("last", F.max("source").over(running)).where("level is not null")
    # only buckets that hold quotes ask for earlier ones
    asked = quotes.select("conv", "key", bucket).distinct().withColumn("asks", F.lit(True))
    carried = latest.join(asked, ["conv", "key", "bucket"], "full").withColumn("carried", F.max("latest").over(before)).where("asks").select("conv", "key", "bucket", "carried")
    near = near.join(carried, ["conv", "key", "bucket"]).withColumn("last", F.coalesce("last", "carried")).join(first, "key", "left")
    near = cut(near.select("conv", "turn", "level", "part", "place", "last", "first", "last_conv").where("last is not null or first.conv < conv"), "sources")
    source = F.when(F.col("last").isNotNull(), F.struct(F.col("conv").alias("conv"), F.col("last").alias("turn"))).when(F.col("first.conv") == F.col("last_conv"), F.col("first"))
    replies = near.select("conv", "turn", F.when(source.isNotNull(), F.struct("level", "part", "place", source.alias("source"))).alias("best"))
    replies = cut(replies.groupBy("conv", "turn").agg(F.min("best").alias("best"), F.sum(F.col("best").isNull().cast("long")).alias("n_common")), "replies")
    trees = _tops(replies.where("best is not null").select(F.struct("conv", "turn").alias("node"), F.col("best.source").alias("up")))
    for done in (quotes, said, near):
        drop(done)
    # ranks need each row's key and place alone; texts meet them once
    slim = base.select("row", "conv", "turn", F.md5(F.coalesce("own", F.lit(""))).alias("digest"))
    slim = slim.join(replies.select("conv", "turn", "n_common"), ["conv", "turn"], "left").withColumn("at", F.struct("conv", "turn")).join(trees, F.col("at") == F.col("node"), "left")
    slim = slim.select("row", "conv", "turn", "digest", "n_common", "reply", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("top.conv", "conv").alias("thread"))
    places = sort_ranked(slim, ["thread"], ["conv", "turn", "digest", "row"], "place").select("row", "n_common", "reply", "depth", "thread", "place")
    return base.join(places, "row").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias("text"), "n_quotes", F.coalesce("n_common", F.lit(0)).cast("long").alias("n_common"),
        F.col("reply.conv").alias("reply_conv"), F.col("reply.turn").alias("reply_turn"), "depth", F.col("thread").alias("thread_conv"), F.col("place").alias("position"),
    )


def _tops(replies: DataFrame) -> DataFrame:
    """For each node with a reply link ``up``: reply, depth and the top of its tree, by doubling."""
    state = cut(replies.select("node", F.col("up").alias("reply"), "up", F.lit(1).cast("long").alias("depth")), "trees")
    while True:
        ahead = state.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = state.join(ahead, F.col("up") == F.col("at"), "left")
        if not moved.where("at is not null").limit(1).count():
            return state.select("node", "reply", "depth", F.col("up").alias("top"))
        step = moved.select("node", "reply", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        after = cut(step, "trees")
        drop(state)
        state = after
