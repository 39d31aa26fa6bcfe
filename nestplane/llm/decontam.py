"""Benchmark decontamination as a prefix-filtered containment join.

A window is 13 consecutive words of an item (the whole item if shorter). Words are ordered by how
often they occur in all documents. As a window has to be contained whole, its necessary prefix is one
token: its rarest word. Document words that are such a token propose the window at the one place
where it can stand; positional and length bounds discard those that would leave the document; a hash
of the stretch and then the words themselves confirm.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestplane.llm.text import LOWER, STEP, WORD, mix, parts, prefix_sums, stretch_hash, tidy, word_hashes, words
from nestplane.sources.shared import Workspace

WINDOW = 13
#: Item words indexed in one pass over the documents; larger benchmarks take more passes.
PASS_WORDS = 2_000_000
TEXT_STEP = STEP ^ 0x5DEECE66C
TEXT_INVERSE = pow(TEXT_STEP, -1, 1 << 64)


def word_lists(texts: pa.Array) -> list[list[bytes]]:
    out = []
    for p in parts(texts):
        low = LOWER[p.data]
        w, raw = words(low, p.offsets, WORD), low.tobytes()
        all_words = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        out += [all_words[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    return out


def hashes_of(items: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(items), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in items])
    return stretch_hash(prefix_sums(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if items else np.zeros(0, np.uint64)


def rarity(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each benchmark word occurs in all documents."""
    vocabulary = np.sort(vocabulary)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        total = np.zeros(len(wanted) + 1, dtype=np.int64)
        for batch in batches:
            for p in parts(batch.column(0)):
                low = LOWER[p.data]
                h = word_hashes(low, words(low, p.offsets, WORD))
                at = np.searchsorted(wanted, h)
                at[at == len(wanted)] = 0
                total[:-1] += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "n"])

    if not len(vocabulary):
        return {}
    counts = docs.select(text_col).mapInArrow(tidy(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(vocabulary[r["word"]]): r["n"] for r in counts.collect()}  # at most one row per benchmark word


class Index:
    """Windows of some items, sorted by the hash of their rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: dict[int, int], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, found in items:
            for i in range(max(1, len(found) - window + 1) if found else 0):
                owners[tuple(found[i : i + window])].add(item)
        self.windows = list(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        flat = hashes_of([x for w in self.windows for x in w])
        size = np.array([len(w) for w in self.windows], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        often = [frequency.get(h, 0) for h in flat.tolist()]
        place = [min(range(a, b), key=lambda k: (often[k], k)) - a for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        token = flat[first[:-1] + np.array(place, dtype=np.int64)] if len(size) else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.tokens, counts = np.unique(token[order], return_counts=True)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.order, self.size, self.place = order, size[order], np.array(place, dtype=np.int64)[order]
        self.hash = stretch_hash(prefix_sums(mix(flat), TEXT_STEP), first[:-1], first[1:], TEXT_INVERSE)[order] if len(size) else token

    def spans(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray):
        """Proposed and hash-confirmed occurrences: (first word, window) arrays."""
        at = np.searchsorted(self.tokens, h)
        at[at == len(self.tokens)] = 0
        where = np.flatnonzero(self.tokens[at] == h)
        count = self.first[at[where] + 1] - self.first[at[where]]
        entry = np.repeat(self.first[at[where]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        spot = np.repeat(where, count)
        start = spot - self.place[entry]
        fits = (start >= first[doc[spot]]) & (start + self.size[entry] <= first[doc[spot] + 1])
        start, entry = start[fits], entry[fits]
        sums = prefix_sums(mix(h), TEXT_STEP)
        same = stretch_hash(sums, start, start + self.size[entry], TEXT_INVERSE) == self.hash[entry]
        return start[same], entry[same]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _match(docs: DataFrame, text_col: str, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = {c: docs.columns.index(c) for c in (text_col, "n_words", "hit_spans", "item_ids")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            spans, items = batch.column(at["hit_spans"]).to_pylist(), batch.column(at["item_ids"]).to_pylist()
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for p in parts(batch.column(at[text_col])):
                low = LOWER[p.data]
                w = words(low, p.offsets, WORD)
                n_words[p.first : p.last] = np.diff(w.first)
                if not len(w.start) or not len(ix.tokens):
                    continue
                start, entry = ix.spans(word_hashes(low, w), w.doc, w.first)
                raw = low.tobytes()
                found: dict[int, list[tuple[int, int]]] = defaultdict(list)
                owned: dict[int, set[str]] = defaultdict(set)
                for s, e in zip(start.tolist(), entry.tolist(), strict=True):
                    k = ix.order[e]
                    window = ix.windows[k]
                    if all(raw[w.start[s + i] : w.end[s + i]] == x for i, x in enumerate(window)):
                        d = int(w.doc[s])
                        a = s - int(w.first[d])
                        found[d].append((a, a + len(window)))
                        owned[d].update(ix.items[k])
                for d, more in found.items():
                    row = p.first + d
                    spans[row] = [{"first": a, "end": b} for a, b in merged([(x["first"], x["end"]) for x in spans[row]] + more)]
                    items[row] = sorted({*items[row], *owned[d]})
            columns = list(batch.columns)
            columns[at["n_words"]] = pa.array(n_words)
            columns[at["hit_spans"]] = pa.array(spans, type=pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            columns[at["item_ids"]] = pa.array(items, type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_words: int = PASS_WORDS
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (word ranges, joined), ``item_ids`` (sorted strings).

    All rows and columns of ``docs`` stay; columns of these names, in any case, are replaced. Null or empty texts have
    no words. Items without words have no window; rows of one item id count once; a null id counts as
    the empty string. Equal windows of several items name them all.

    The benchmark is read on the driver in blocks of whole items with at most ``pass_words`` bytes-split
    words (or one item), by ``item_col`` order; each block is one pass over all documents, so any size works.
    """
    spark = docs.sparkSession
    state = {
        "n_words": F.lit(0).cast("bigint"),
        "hit_spans": F.array().cast("array<struct<first:bigint,end:bigint>>"),
        "item_ids": F.array().cast("array<string>"),
    }
    kept = [c for c in docs.columns if c.lower() not in {*state, "n_hit"}]
    out = docs.select(*kept, *[v.alias(k) for k, v in state.items()])
    space, block, size, done = Workspace(spark, "decontam"), [], 0, 0

    def passed(df: DataFrame, last: bool) -> DataFrame:
        flat = [x for _, found in block for x in set(found)]
        index = Index(block, rarity(df, text_col, np.unique(hashes_of(flat))), window)
        df = _match(df, text_col, index)
        return df if last else space.write(df, f"pass{done}")

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    for row in rows.orderBy("item").toLocalIterator():
        found = word_lists(pa.array([row["text"]], type=pa.string()))[0]
        if block and size + len(found) > pass_words:
            out, block, size, done = passed(out, False), [], 0, done + 1
        block.append((row["item"], found))
        size += len(found)
    out = passed(out, True)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return out.withColumn("n_hit", n_hit)


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
