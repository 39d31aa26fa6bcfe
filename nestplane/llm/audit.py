"""How text filters interact: which documents each would remove, in any order.

Copies are found with compressed radix tries over whole texts. Every task first puts its own texts into one, so
copies inside a task leave it as rows without text. The remaining texts are range-partitioned by prefixes,
which are lengthened where too much text shares one, and each partition's trie holds the smallest id at
every terminal: a row whose id is larger is a copy. What is left of a document is its id, its part and the mask
of the filters it fails; the masks are counted by part, and any order of the filters follows from the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestplane.llm.text import tidy
from nestplane.sources.shared import Workspace

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Text (and ``ROW_BYTES`` for every row) that one task's trie takes.
PART_BYTES = 32 << 20
ROW_BYTES = 512
PREFIX = 8  # bytes of the shortest prefix; a crowded one becomes four times as long
BROADCAST_BYTES = 64 << 20

UPPER = bytes(range(0x41, 0x5B))
INNER = bytes(range(0x80, 0xC0))  # bytes inside a character
MARKS = b"#$%&*|"


def own_mask(raw: bytes) -> int:
    """Filters A to D that a text (UTF-8) fails."""
    words = raw.split()  # at 0x20 and 0x09 to 0x0D
    upper = len(raw) - len(raw.translate(None, UPPER))
    points = len(raw.translate(None, INNER))
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 | marked << 3


# --- tries --------------------------------------------------------------------------------------


class Node:
    __slots__ = ("label", "below", "held")

    def __init__(self, label: bytes, below: dict[int, Node]):
        self.label, self.below, self.held = label, below, None


def common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text[at:]``, which differ within ``label``."""
    a = np.frombuffer(label, np.uint8)
    b = np.frombuffer(text, np.uint8, min(len(label), len(text) - at), at)
    differ = a[: len(b)] != b
    return int(differ.argmax()) if differ.any() else len(b)


class Trie:
    """A compressed radix trie over bytes; ``held`` of a node is what its owner keeps at the terminal."""

    def __init__(self):
        self.root = Node(b"", {})

    def insert(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:], {})
                return child
            if not text.startswith(child.label, at):
                k = common(child.label, text, at)
                middle = node.below[text[at]] = Node(child.label[:k], {child.label[k]: child})
                child.label = child.label[k:]
                child = middle
            node, at = child, at + len(child.label)
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """Every terminal with its whole text, in the order of the texts."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            text = before + node.label
            if node.held is not None:
                yield text, node
            todo += [(text, node.below[k]) for k in sorted(node.below, reverse=True)]


def rows_of(kind: pa.DataType, with_text: bool) -> pa.Schema:
    fields = [("id", kind), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())]
    return pa.schema(fields + [("text", pa.binary())] * with_text)


def first_tries(failed: Callable[[bytes], int], most: int) -> Callable:
    """One trie per task, emptied when it has grown beyond ``most`` bytes.

    A row with an id larger than another's with the same text is known for a copy at once. The rows of each
    text's smallest id leave with the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size, out, schema = Trie(), 0, [], None

        def known(key, parts: dict[str, int], mask: int) -> None:
            out.extend((key, part, mask, n, None) for part, n in parts.items())

        def released() -> Iterator[pa.RecordBatch]:
            nonlocal trie, size
            weight = 0
            for text, node in trie.terminals():
                key, parts, mask = node.held
                out.extend((key, part, mask, n, text) for part, n in parts.items())
                weight += len(text) * len(parts) + ROW_BYTES
                if weight > most // 8:
                    yield batched()
                    weight = 0
            trie, size = Trie(), 0

        def batched() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or rows_of(batch.schema.field(0).type, True)
            raw = batch.column(2).cast(pa.binary())
            for key, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw, strict=True):
                text = text.as_py() or b""
                if key is None:
                    out.append((None, part, failed(text), 1, None))
                    continue
                node = trie.insert(text)
                if node.held is None:
                    node.held = (key, {part: 1}, failed(text))
                    size += len(text) + ROW_BYTES
                else:
                    least, parts, mask = node.held
                    if key > least:
                        out.append((key, part, mask | COPY, 1, None))
                    elif key == least:
                        parts[part] = parts.get(part, 0) + 1
                    else:
                        known(least, parts, mask | COPY)
                        node.held = (key, {part: 1}, mask)
                if size > most:
                    yield from released()
            if len(out) > 10_000:
                yield batched()
        if schema is not None:
            yield from released()
            yield batched()

    return run


def last_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie per partition, with the smallest id at every terminal; its rows, copies marked."""
    trie, rows, schema = Trie(), [], None
    for batch in batches:
        schema = schema or rows_of(batch.schema.field(0).type, False)
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for key, part, mask, n, text in zip(*columns, batch.column(4), strict=True):
            node = trie.insert(text.as_py())
            node.held = key if node.held is None else min(node.held, key)
            rows.append((node, key, part, mask, n))
    for k in range(0, len(rows), 20_000):
        own = [(key, part, mask | COPY * (key > node.held), n) for node, key, part, mask, n in rows[k : k + 20_000]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), schema.types, strict=True)], schema=schema)


# --- documents ----------------------------------------------------------------------------------


def prefixed(texts: DataFrame, space: Workspace, most: int) -> DataFrame:
    """``texts`` with ``prefix``, the beginning that decides the partition, so long that at most about ``most`` bytes share one.

    Only copies of one text may weigh more; a trie holds these once.
    """
    size = F.octet_length("text")
    out, length, step = texts.withColumn("cut", F.lit(PREFIX)), PREFIX, 0
    while True:
        begins = F.when(F.col("cut") == length, F.substring("text", 1, length))
        weights = out.select(begins.alias("begins"), size.alias("size")).where("begins is not null")
        crowded = weights.groupBy("begins").agg(F.sum(F.col("size") + ROW_BYTES).alias("weight"), F.max("size").alias("longest"))
        crowded = space.write(crowded.where((F.col("weight") > most) & (F.col("longest") > length)).select("begins"), f"crowded{step}")
        number = crowded.count()  # at most the bytes of all texts / most
        if not number:
            return out.withColumn("prefix", F.expr("substring(text, 1, cut)")).drop("cut")
        crowded = F.broadcast(crowded) if number * length <= BROADCAST_BYTES else crowded
        longer = F.when(F.col("begins").isNotNull(), F.lit(4 * length)).otherwise(F.col("cut"))
        out = out.withColumn("own", begins).join(crowded, F.col("own") == F.col("begins"), "left").withColumn("cut", longer).drop("own", "begins")
        length, step = 4 * length, step + 1


def flags(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    failed: Callable[[bytes], int] = own_mask,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``(id, part, mask, n)``: the rows of ``docs`` by id, part (null: empty) and the filters they fail (bit 0: A).

    ``failed`` gives the mask of a text by itself; ``COPY`` is added where a row with a smaller id has the same whole
    text (null: empty). Rows of one id are no copies of each other; a null id is neither a copy nor an original. A
    row with ``n`` above 1 stands for that many equal rows.
    """
    space = Workspace(docs.sparkSession, "audit")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, part string, mask int, n bigint"
    first = space.write(rows.mapInArrow(tidy(first_tries(failed, part_bytes)), f"{schema}, text binary"), "first")
    open_rows = first.where("text is not null")
    weight = open_rows.agg(F.sum(F.octet_length("text").cast("bigint") + ROW_BYTES)).first()[0] or 0
    dealt = prefixed(open_rows, space, part_bytes // 2).repartitionByRange(-(-weight // part_bytes) or 1, "prefix")
    last = dealt.select("id", "part", "mask", "n", "text").mapInArrow(tidy(last_tries), schema)
    return last.unionByName(first.where("text is null").drop("text"))


def facts(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, good, toxic)`` per labelled id: whether any of its rows says so."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.groupBy(F.col(id_col).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


STEP_SCHEMA = T.StructType(
    [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def steps(cells: pa.Table) -> pa.Table:
    """All orders of the filters for one part, from its counts by mask (at most 4 rows a mask)."""
    mask, n = cells["mask"].to_numpy(), cells["n"].to_numpy()
    good, toxic = (n * cells[c].to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
    failing = np.array([int(m).bit_count() for m in mask])
    part, out = cells["part"][0].as_py(), []
    orders = len(list(permutations(FILTERS)))
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails, gone = (mask & bit) > 0, (mask & before) > 0
            now = fails & ~gone
            # of the orders, a row's first failing filter is each of those it fails equally often
            shapley = int((n[fails] * (orders // np.maximum(failing[fails], 1))).sum())
            kept = n[(mask & (before | bit)) == 0].sum()
            counts = (kept, n[now].sum(), n[fails & gone].sum(), n[mask == bit].sum(), good[now].sum(), toxic[now].sum(), shapley)
            out.append((part, "".join(order), k + 1, *map(int, counts)))
            before |= bit
    names = STEP_SCHEMA.names
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def audit(flagged: DataFrame, labels: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """Per part, order of the filters and step: what is kept and removed, and what else the step's filter does.

    ``flagged`` as of ``flags``; ``labels`` (``id_col, quality, toxic``) may be absent or cover any part. No rows give no rows.
    """
    counts = flagged.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    if labels is None:
        known = counts.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        known = counts.join(facts(labels, id_col), "id", "left")
    lost = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    cells = known.select("part", "mask", *lost, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return cells.groupBy("part").applyInArrow(steps, STEP_SCHEMA)


def fails(name: str) -> Column:
    """Whether a row of ``flags`` fails the filter of this letter."""
    return F.col("mask").bitwiseAND(1 << FILTERS.index(name)) > 0
