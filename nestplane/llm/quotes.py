"""Quotation linking: from quoted messages to reply-ordered conversations without quotes.

Lines that begin with ``>`` marks are quoted, as deep as there are marks. Consecutive lines of one depth are a passage. Its
words, whatever the line breaks, are hashed in shingles of five (a shorter passage: as a whole); it is linked to the
earlier message of the conversation whose own words hold most of them, at least four in five. Candidates come from the passage's
rarest shingles, as many as one of them must occur, and are verified with all. A message answers the one that its shallowest
passages lead to, else the turn before it, and conversations are put in the order of the reply tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nestplane.llm.joins import beside
from nestplane.llm.text import tidy
from nestplane.operators.points import row_index
from nestplane.sources.shared import Workspace

SHINGLE, SHARE = 5, 0.8
#: Quote marks at the beginning of a line, blanks between them allowed.
QUOTED = re.compile(r"[ \t]*>[> \t]*")
HAS_QUOTE = r"(?m)^[ \t]*>"
#: A line that announces a quotation (fixed forms in four languages).
ANNOUNCED = re.compile(r"\s*(on .*wrote|le .*a écrit|am .*schrieb.*|el .*escribió)\s*:\s*", re.IGNORECASE)
BREAK = re.compile(r"\r\n|\n|\r")
WORD = re.compile(r"[^\W_]+")
TURNS = 1024  # turns of a bucket in which the latest earlier message is looked for


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], size: int) -> list[int]:
    """Signed 64-bit hashes of the distinct runs of ``size`` words."""
    found = {xxhash.xxh64_intdigest(" ".join(words[k : k + size])) for k in range(len(words) - size + 1)}
    return sorted(h - (1 << 64) if h >> 63 else h for h in found)


def parse(text: str) -> tuple[str, list[tuple[int, int, list[str]]], int]:
    """Own text without quotes and their announcements, passages ``(level, lines, words)``, and the number of quoted lines."""
    own, passages, last, quoted = [], [], 0, 0
    for line in BREAK.split(text):
        m = QUOTED.match(line)
        level = m[0].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            quoted += 1
            if level != last:
                passages.append((level, 0, []))
            _, lines, words = passages[-1]
            passages[-1] = (level, lines + 1, words + words_of(line[m.end() :]))
        last = level
    if not quoted:
        return text, [], 0
    return "\n".join(x for x in own if not ANNOUNCED.fullmatch(x)).strip(), passages, quoted


def parsed(messages: DataFrame) -> DataFrame:
    """``(msg, own, quoted_lines, passages)`` of messages with a quoted line; a passage has its level, lines, shingle size and hashes."""
    kind = pa.struct([("level", pa.int32()), ("lines", pa.int64()), ("size", pa.int32()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(t) for t in batch.column(1).to_pylist()]
            passages = [
                [{"level": v, "lines": n, "size": min(SHINGLE, len(w)), "hashes": shingles(w, min(SHINGLE, len(w))) if w else []} for v, n, w in p] for _, p, _ in rows
            ]
            arrays = [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array(passages, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(arrays, names=["msg", "own", "quoted_lines", "passages"])

    schema = "msg bigint, own string, quoted_lines bigint, passages array<struct<level:int,lines:bigint,size:int,hashes:array<bigint>>>"
    return messages.select("msg", "text").mapInArrow(tidy(run), schema)


def own_shingles(messages: DataFrame, kind: str) -> DataFrame:
    """``(conv, turn, cls, size, hash)``: shingles of the wanted ``sizes`` of each message's own words; ``cls`` is the same for equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, (text, sizes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = words_of(text)
                cls = xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)
                for size in sizes:
                    found = shingles(words, size) if len(words) >= size else []
                    rows += [k] * len(found)
                    out += [(cls, size, h) for h in found]
            at = pa.array(rows, pa.int64())
            cls, size, hashes = zip(*out, strict=True) if out else ((),) * 3
            arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), pa.array(hashes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "turn", "cls", "size", "hash"])

    return messages.select("conv", "turn", "own", "sizes").mapInArrow(tidy(run), f"conv {kind}, turn bigint, cls bigint, size int, hash bigint")


def latest_before(asks: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """``asks`` with ``source``, the greatest ``turn`` of ``sources`` of the same keys below their own (null: none).

    Turns are looked up within buckets of ``TURNS``, and what lies before a bucket comes from a row per bucket, so no key is one task's.
    """
    bucket = F.floor(F.col("turn") / TURNS)
    both = asks.withColumn("given", F.lit(None).cast("bigint")).unionByName(
        sources.select(*keys, "turn", F.col("turn").alias("given")), allowMissingColumns=True
    ).withColumn("bucket", bucket)
    order = Window.partitionBy(*keys, "bucket").orderBy("turn", F.col("given").isNotNull())
    near = both.withColumn("near", F.max("given").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = both.groupBy(*keys, "bucket").agg(F.max("given").alias("last")).withColumn("far", F.max("last").over(earlier)).drop("last")
    found = near.where("given is null").join(far, [*keys, "bucket"], "left")
    return found.select(*asks.columns, F.coalesce("near", "far").alias("source"))


def passage_links(quoted: DataFrame, messages: DataFrame, space: Workspace) -> DataFrame:
    """``(msg, level, lines, shared, source)`` per passage that an earlier message of its conversation wrote; the latest of those that share most."""
    kind = messages.schema["conv"].dataType.simpleString()
    asked = quoted.select("conv", "turn", "msg", F.posexplode("passages").alias("number", "p")).where("size(p.hashes) > 0 and conv is not null and turn is not null")
    asked = asked.select("conv", "turn", "msg", "number", "p.*").withColumn("passage", F.xxhash64("size", "hashes"))
    asked = space.write(asked, "asked")
    passages = asked.dropDuplicates(["conv", "passage"]).select("conv", "passage", "size", F.size("hashes").alias("total"), "hashes")
    want = space.write(passages.select("conv", "passage", "size", "total", F.explode("hashes").alias("hash")), "want")
    sizes = space.write(want.groupBy("conv").agg(F.collect_set("size").alias("sizes")), "sizes")  # five numbers at most
    texts = beside(messages.where("turn is not null"), sizes, ["conv"], ["msg"])
    sources = space.write(own_shingles(texts, kind), "sources")
    held = sources.select("conv", "cls", "size", "hash").distinct()
    often = held.groupBy("conv", "size", "hash").agg(F.count("*").alias("often"))
    ranked = want.join(often, ["conv", "size", "hash"], "left")
    rarest = Window.partitionBy("conv", "passage").orderBy(F.coalesce("often", F.lit(0)), "hash")
    needed = F.ceil(F.col("total") * SHARE)
    prefix = ranked.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= F.col("total") - needed + 1).where("often is not null")
    pairs = prefix.join(held, ["conv", "size", "hash"]).select("conv", "passage", "cls").distinct()
    shared = pairs.join(want, ["conv", "passage"]).join(held, ["conv", "cls", "size", "hash"]).groupBy("conv", "passage", "cls", "total").agg(F.count("*").alias("shared"))
    links = space.write(shared.where(F.col("shared") >= needed).select("conv", "passage", "cls", "shared"), "links")
    asks = asked.select("conv", "turn", "msg", "number", "level", "lines", "passage").join(links, ["conv", "passage"])
    turns = sources.select("conv", "cls", "turn").distinct()
    found = latest_before(asks, turns, ["conv", "cls"]).where("source is not null")
    best = F.max_by(F.struct("level", "lines", "shared", "source"), F.struct("shared", "source")).alias("b")
    return found.groupBy("msg", "number").agg(best).select("msg", "b.*")


def tree_order(nodes: DataFrame, space: Workspace) -> DataFrame:
    """``(msg, reply_order)``: place of each message in its conversation's reply tree, parents first, then in the order of turns.

    ``nodes`` are ``(conv, at, msg, up)``, ``up`` the parent's ``msg`` or null. Conversations in which every message answers the one before
    it are in that order already. For the others the tour around the tree is a list, ranked by pointer jumping: as many joins as
    the doubled length of the longest conversation has binary digits.
    """
    kin = Window.partitionBy("conv", "up").orderBy("at", "msg")
    child = nodes.withColumn("right", F.lead("msg").over(kin))
    first = nodes.groupBy("conv", "up").agg(F.min_by("msg", F.struct("at", "msg")).alias("down"))
    down = first.where("up is not null").select(F.col("up").alias("msg"), "down")
    tour = space.write(child.join(down, "msg", "left").select("conv", "msg", "up", "right", "down"), "tour")
    # a message is entered (even) and left (odd); what follows either, and how many messages are entered from there on
    enter = tour.select((F.col("msg") * 2).alias("e"), F.coalesce(F.col("down") * 2, F.col("msg") * 2 + 1).alias("next"), F.lit(1).cast("bigint").alias("n"))
    leave = tour.select((F.col("msg") * 2 + 1).alias("e"), F.coalesce(F.col("right") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).cast("bigint").alias("n"))
    steps = space.write(enter.unionByName(leave), "steps0")
    k = 0
    while steps.where("next is not null").head(1):
        ahead = steps.select(F.col("e").alias("next"), F.col("next").alias("after"), F.col("n").alias("more"))
        grown = steps.join(ahead, "next", "left").select("e", F.col("after").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        before, k = steps, k + 1
        steps = space.write(grown, f"steps{k}")
        space.drop(before)
    sizes = nodes.groupBy("conv").agg(F.count("*").alias("all"))
    left = steps.where("e % 2 = 0").select(F.expr("e div 2").alias("msg"), "n")
    return beside(nodes.select("conv", "msg"), sizes, ["conv"], ["msg"]).join(left, "msg").select("msg", (F.col("all") - F.col("n") + 1).alias("reply_order"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """One row per message: ``conv_col, turn_col, role_col, text, parent_turn, quoted_lines, linked_lines, deepest, reply_order``.

    ``text`` is without quotes and their announcements; a message without a quoted line keeps its text as it is. ``parent_turn`` is the answered
    turn (null for the first of a conversation); ``linked_lines`` counts the lines of the passages that an earlier message of the
    conversation wrote, ``deepest`` their deepest level. ``reply_order`` numbers a conversation's messages from 1 in the order of the
    reply tree: every message after the one it answers, answers to one message by turn, each with all that follows from it. Null
    texts are empty; rows with a null conversation or turn stay, unlinked, after the others (null turn) or in a conversation of
    their own (null id). Repeated rows are messages of their own, told apart by a row number; a quote leads to their common turn.
    """
    space = Workspace(messages.sparkSession, "quotes")
    base = space.write(
        messages.select(
            F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("msg"),
        ),
        "messages",
    )
    cut = space.write(parsed(base.where(F.col("text").rlike(HAS_QUOTE))), "parsed")
    quoted = base.select("conv", "turn", "msg").join(cut, "msg")
    owned = base.join(cut.select("msg", "own"), "msg", "left").withColumn("own", F.coalesce("own", "text")).select("conv", "turn", "msg", "own")
    linked = space.write(passage_links(quoted, owned, space), "linked")
    answer = linked.groupBy("msg").agg(
        F.min(F.struct("level", (-F.col("shared")).alias("few"), (-F.col("source")).alias("late"))).alias("best"), F.sum("lines").alias("linked_lines"), F.max("level").cast("bigint").alias("deepest")
    )
    turns = base.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min("msg").alias("head"))
    turns = space.write(turns, "turns")
    numbered = row_index(turns.select("conv", "turn"), ["turn"], ("conv",))
    before = numbered.select("conv", F.col("turn").alias("previous"), (F.col("row") + 1).alias("row"))
    prior = numbered.join(before, ["conv", "row"], "left").select("conv", "turn", "previous")
    facts = base.join(cut.select("msg", "own", "quoted_lines"), "msg", "left").join(answer, "msg", "left").join(prior, ["conv", "turn"], "left")
    out = facts.select(
        "conv", "turn", "role", "msg", F.coalesce("own", "text").alias("text"), (-F.col("best.late")).alias("linked"), "previous",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("quoted_lines", "linked_lines", "deepest")],
    ).withColumn("parent_turn", F.coalesce("linked", "previous"))
    out = space.write(out, "facts")
    thread = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    at = F.coalesce("turn", F.lit((1 << 63) - 1))
    plain = row_index(out.select(thread.alias("thread"), at.alias("at"), "msg"), ["at", "msg"], ("thread",), "reply_order").select("msg", "reply_order")
    # only where an answer leaves the line of turns does the tree differ from it
    jumps = out.where("linked is not null and linked <> previous").select("conv").distinct()
    jumps = space.write(jumps.withColumn("jumps", F.lit(True)), "jumps")
    marked = beside(out.select("conv", "turn", "msg", "parent_turn"), jumps, ["conv"], ["msg"], "left")
    inside = marked.where("jumps").select("conv", at.alias("at"), "msg", "parent_turn")
    heads = turns.select("conv", F.col("turn").alias("parent_turn"), F.col("head").alias("up"))
    inside = space.write(inside.join(heads, ["conv", "parent_turn"], "left").select("conv", "at", "msg", "up"), "inside")
    if inside.head(1):
        ordered = tree_order(inside, space)
        plain = plain.join(ordered.withColumnRenamed("reply_order", "place"), "msg", "left").select("msg", F.coalesce("place", "reply_order").alias("reply_order"))
    done = out.join(plain, "msg").select("conv", "turn", "role", "text", "parent_turn", "quoted_lines", "linked_lines", "deepest", "reply_order")
    return done.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col).withColumnRenamed("role", role_col)


def rendered(role: str | Column = "role", text: str | Column = "text") -> Column:
    """A message as chat text: a role line, then the text."""
    r, t = (F.col(c) if isinstance(c, str) else c for c in (role, text))
    return F.concat(F.lit("<|"), F.coalesce(r, F.lit("user")), F.lit("|>\n"), F.coalesce(t, F.lit("")), F.lit("\n"))
