"""Best-fit packing with swap-based local search.

Documents become pieces of token ids; a longer document is cut so that all its pieces but the first are
whole sequences. Pieces shorter than a sequence are packed in blocks of bounded size: best-fit
decreasing, then a local search among the underfull bins that moves a piece, exchanges one for one or
two for one whenever the sum of squared fills grows, until the emptiest bins are empty. Pieces of bins
that stay underfull go, with those of the other blocks, into the next, far smaller level.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestplane.llm.text import tidy
from nestplane.llm.tokens import encoder
from nestplane.sources.shared import Workspace

CAPACITY = 2048
END_ID = 0
BLOCK = 20_000  # pieces packed by one task
LEVELS = 4
FULL = 0.995  # bins filled beyond this share do not go to the next level
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: all full but the first."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every row: its id, ``piece, start, length, ids_crc32`` and, if asked for, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows, out, held = [], [], []
            for row, found in enc.texts(batch.column(1)):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length])))
                    if with_ids:
                        held.append(ids[start : start + length].astype(np.int32))
            k, start, length, crc = zip(*out, strict=True) if out else ((),) * 4
            arrays = [batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(held, type=pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {PIECES}" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Bins by free space, and a bit mask of which spaces occur."""
    bins: list[list[int]] = []
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = spaces[space].pop()
            if not spaces[space]:
                mask &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        spaces[space - n].append(b)
        mask |= 1 << (space - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges among underfull bins while the squared fill grows.

    Bins are finished one after the other, the fullest first, each from emptier bins only, so every step increases the sum of squares and
    the emptiest bins run empty. A finished bin's pieces leave the pool, so the longest piece that fits is found at once.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: -fill[b])
    live = [set(b) for b in bins]
    pool = sorted((lengths[i], i, b) for b in order for i in bins[b])  # pieces that may move

    def leave(i: int, b: int) -> None:
        pool.pop(bisect_right(pool, (lengths[i], i, b)) - 1)

    def take(i: int, b: int, into: int, target: int) -> None:
        live[b].discard(i)
        live[into].add(i)
        fill[b] -= lengths[i]
        fill[into] += lengths[i]
        if b != target:
            leave(i, b)
        if into != target:
            insort(pool, (lengths[i], i, into))

    def donor(most: int, least: int, target: int, but: int = -1):
        """The longest piece of ``least`` to ``most`` ids in a bin emptier than the target."""
        k = bisect_right(pool, (most, 1 << 62, 0)) - 1
        while k >= 0 and pool[k][0] >= least:
            _, i, b = pool[k]
            if i != but and fill[b] <= fill[target]:
                return pool[k]
            k -= 1
        return None

    for target in order:
        for i in live[target]:
            leave(i, target)
        while live[target] and fill[target] < capacity:
            gap = capacity - fill[target]
            best = (0, None, None)
            if found := donor(gap, 1, target):
                best = (found[0], [(found[1], found[2])], None)
            if best[0] < gap:
                for n, i in sorted({lengths[i]: i for i in live[target]}.items()):
                    if (one := donor(n + gap, n + 1, target)) and fill[target] + one[0] - n > fill[one[2]] and one[0] - n > best[0]:
                        best = (one[0] - n, [(one[1], one[2])], i)
                    if (a := donor((n + gap) // 2 + 1, 1, target)) and (c := donor(n + gap - a[0], 1, target, a[1])):
                        gain = a[0] + c[0] - n
                        if best[0] < gain <= gap and fill[a[2]] + n - a[0] <= capacity:
                            best = (gain, [(a[1], a[2]), (c[1], c[2])], i)
                    if best[0] == gap:
                        break
            if best[1] is None:
                break
            _, moved, given = best
            back, touched = moved[0][1], {target, *[b for _, b in moved]}
            before = sum(fill[b] ** 2 for b in touched)
            for i, b in moved:
                take(i, b, target, target)
            if given is not None:
                take(given, target, back, target)
            if fill[back] > capacity or sum(fill[b] ** 2 for b in touched) <= before:  # no gain: undo and stop
                if given is not None:
                    take(given, back, target, target)
                for i, b in moved:
                    take(i, target, b, target)
                break
    return [sorted(b, key=lambda i: -lengths[i]) for b in live if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def packed(placed: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pieces (with a ``length`` up to ``capacity``) with their ``sequence_id`` and gapless ``offset``.

    Full pieces are sequences of their own. The others are packed in blocks dealt by a hash of the row;
    equal rows stay separate pieces. All columns stay (those of the two names are replaced). Empty input gives an empty result.
    """
    space, row = Workspace(placed.sparkSession, "packing"), "row"
    while row in {c.lower() for c in placed.columns}:
        row += "_"
    kept = [c for c in placed.columns if c.lower() not in ("sequence_id", "offset")]
    stored = space.write(placed.select(*kept, F.monotonically_increasing_id().alias(row)), "pieces")
    out = [stored.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col(row) * 8 + 7, "offset": F.lit(0).cast("bigint")})]
    rest = stored.where(F.col("length") < capacity)
    schema = "row bigint, length bigint, sequence_id bigint, offset bigint, open boolean"

    def run(level: int, last: bool):
        def one(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("row")
            lengths, rows, at = part["length"].tolist(), part["row"].to_numpy(), int(part["block"].iloc[0])
            order, seq, off, more = [], [], [], []
            for k, b in enumerate(pack(lengths, capacity)):
                place = 0
                for i in b:
                    order.append(i)
                    seq.append((((at << 24) + k) << 3) + level)
                    off.append(place)
                    place += lengths[i]
                more += [not last and place < FULL * capacity] * len(b)
            return pd.DataFrame({"row": rows[order], "length": np.array(lengths)[order], "sequence_id": seq, "offset": off, "open": more})

        return one

    rest, n = rest.select(F.col(row).alias("row"), "length"), rest.count()
    places = []
    for level in range(LEVELS):
        if not n:
            break
        blocks = -(-n // block)
        last = blocks == 1 or level == LEVELS - 1
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        level_out = space.write(dealt.groupBy("block").applyInPandas(run(level, last), schema), f"level{level}")
        places.append(level_out.where("not open").drop("open"))
        rest = level_out.where("open").select("row", "length")
        n = 0 if last else rest.count()
    if places:
        every = places[0]
        for p in places[1:]:
            every = every.unionByName(p)
        out.append(stored.join(every.drop("length").withColumnRenamed("row", row), row))
    result = out[0]
    for p in out[1:]:
        result = result.unionByName(p)
    return result.drop(row)


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every row's ids (then ``end_id``) as pieces in sequences of at most ``capacity`` ids.

    ``(id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset)``. A null or empty text is the end
    id alone; repeated rows and null ids are packed like any other. Columns other than the two named are ignored.
    """
    return packed(pieces(docs, id_col, text_col, capacity, end_id, tokenizer, with_ids), id_col, capacity)
