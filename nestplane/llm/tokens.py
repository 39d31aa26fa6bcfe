"""Token ids of whole texts, and edit-aware token counts.

``Encoder`` finds the pre-tokens of many texts at once from the classes of their characters, looks each
up by its hash in a per-worker table, and runs byte-pair merging only for pre-tokens not seen before. The
ids equal those of the tokenizer file.

The edit-aware part keeps, per document, a tree of token counts over segments that end where a
non-space is followed by white space. No pre-token crosses such a place, so a segment's tokens do
not depend on its neighbours, and an edit re-encodes only the segments it touches (and a neighbour whose
boundary it destroyed).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestplane.llm.text import parts, prefix_sums, stretch_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Known pre-tokens a worker keeps before it starts afresh.
KNOWN = 600_000
FIRST_ROOM = 150_000
#: Contractions that the pattern takes as one pre-token (fixed values).
CONTRACTED = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_tables: list[np.ndarray] = []
_encoders: dict[str, Encoder] = {}


def character_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties the pattern names."""
    if not _tables:
        import regex

        table = np.full(0x110000, OTHER, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                table[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), OTHER, kind)
        _tables.append(table)
    return _tables[0]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file (null: the installed byte-level one)."""
    path = path or default_tokenizer()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self, room: int = FIRST_ROOM) -> None:
        self.room, bits = room, (3 * room).bit_length()
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.slots = np.zeros(1 << bits, np.uint64)  # open addressing: hashes, and the entry of each
        self.entry = np.zeros(1 << bits, np.int32)
        self.known, self.used = 0, 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def learn(self, h: np.ndarray, tokens: list[bytes]) -> None:
        encode = self.bpe.encode_ordinary
        found = [encode(t.decode("utf-8")) for t in tokens]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(size.sum()))
        while self.known + len(size) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        number = np.arange(self.known, self.known + len(size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[number], self.size[number] = self.used + np.cumsum(size) - size, size
        self.used, self.known = self.used + len(flat), self.known + len(size)
        slot = (h >> np.uint64(self.shift)).astype(np.int64)
        while len(slot):  # each free place takes one hash a round, the others move on
            free = np.flatnonzero(self.slots[slot] == 0)
            takes = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[takes]], self.entry[slot[takes]] = h[takes], number[takes]
            left = np.ones(len(slot), dtype=bool)
            left[takes] = False
            slot, h, number = (slot[left] + 1) & self.mask, h[left], number[left]

    def find(self, h: np.ndarray):
        """Entry of each hash, and which are not known."""
        slot = (h >> np.uint64(self.shift)).astype(np.int64)
        held = self.slots[slot]
        out = self.entry[slot].astype(np.int64)
        unknown = held == 0
        todo = np.flatnonzero((held != h) & ~unknown)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.slots[slot[todo]]
            out[todo] = self.entry[slot[todo]]
            unknown[todo] = held == 0
            todo = todo[(held != h[todo]) & (held != 0)]
        return out, unknown

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Byte starts of all pre-tokens of some texts, the character class before and at each, and the document of each."""
        lead = (data & 0xC0) != 0x80  # first bytes of characters
        at = np.flatnonzero(lead)
        if data.size and data.max() >= 0x80:
            point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        else:
            point = data
        kind = character_classes()[point]
        doc_first = np.zeros(len(at) + 1, dtype=bool)
        doc_first[np.searchsorted(at, offsets)] = True
        doc_first = doc_first[:-1]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        before[doc_first] = 0
        change = kind != before
        begins = change & (kind != SPACE)  # a run of letters, numbers or others
        blank = (point == 0x20) & (kind == SPACE)
        # the last white space before a run: a blank joins the run, any other stands alone
        last = np.zeros(len(at), dtype=bool)
        last[:-1] = begins[1:] & (kind[:-1] == SPACE) & ~doc_first[1:]
        starts = (begins & ~np.concatenate([[False], (last & blank)[:-1]])) | last | (change & (kind == SPACE))
        tick = np.flatnonzero((point == 0x27) & begins)
        if len(tick):  # contractions at the start of a run of one apostrophe that no blank joined
            tick = tick[starts[tick]]
            text = data.tobytes()
            ends = np.append(at, len(data))
            stop = offsets[np.searchsorted(offsets, at[tick], side="right")]
            for k, s in zip(tick.tolist(), stop.tolist(), strict=True):
                if m := CONTRACTED.match(text[at[k] : min(ends[min(k + 3, len(at))], s)].decode("utf-8")):
                    starts[k + 1 : k + len(m[0])] = False
                    after = k + len(m[0])
                    if after < len(at) and not doc_first[after]:
                        if kind[after] != SPACE:
                            starts[after] = True
        found = np.flatnonzero(starts)
        return at[found], before[found], kind[found], np.searchsorted(offsets, at[found], side="right") - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """``(ids, first)``: all ids end to end, and where each document's begin. Plain text only, no special tokens."""
        start, _, _, doc = self.pieces(data, offsets)
        which = self.lookup(data, start)
        size = self.size[which]
        ids = self.gather(which, size)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(doc, np.arange(len(offsets)))]

    def counts(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Number of ids of each pre-token."""
        which = self.lookup(data, start)  # may grow the table
        return self.size[which]

    def lookup(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        end = np.append(start[1:], len(data)) if len(start) else start
        h = stretch_hash(prefix_sums(data), start, end) | np.uint64(1)
        out, unknown = self.find(h)
        if unknown.any():
            new = np.flatnonzero(unknown)
            fresh, one = np.unique(h[new], return_index=True)
            if self.known + len(fresh) > self.room:
                fresh, one = np.unique(h, return_index=True)
                new = np.arange(len(h))
                self.forget(max(min(KNOWN, 4 * self.room), len(fresh)))  # a very long text may need a larger table
            raw, one = data.tobytes(), new[one]
            self.learn(fresh, [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
            out, _ = self.find(h)
        return out

    def gather(self, which: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = int(size.sum())
        step = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
        return self.ids[np.repeat(self.first[which] - step, size) + np.arange(total)]

    def marked(self, text: str) -> list[int]:
        """Ids of a text that holds a special token's string: that stays one token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, ids)`` of every text; null counts as empty."""
        for p in parts(column):
            raw = p.data.tobytes()
            odd = any(s.encode() in raw for s in self.special)
            ids, first = self.encode(p.data, p.offsets)
            for i in range(p.last - p.first):
                own = raw[p.offsets[i] : p.offsets[i + 1]] if odd else b""
                if any(s.encode() in own for s in self.special):
                    yield p.first + i, np.array(self.marked(own.decode("utf-8")), dtype=np.uint32)
                else:
                    yield p.first + i, ids[first[i] : first[i + 1]]


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# --- edit-aware counts --------------------------------------------------------------------------

SEGMENT = 64  # pre-tokens a segment has at least, unless the text ends
SHORT = 16 * SEGMENT  # characters up to which an edited stretch stays one segment
EDIT_TYPE = "array<struct<pos:bigint,del:bigint,ins:string>>"


class CountTree:
    """Segments of one document with a binary tree of (characters, tokens) over them."""

    def __init__(self, texts: list[str], counts: list[int]):
        self.texts, self.counts = texts, counts
        self.build()

    def build(self) -> None:
        n = max(1, len(self.texts))
        self.leaves = 1 << (n - 1).bit_length()
        self.sums = [[0] * (2 * self.leaves), [0] * (2 * self.leaves)]
        for which, values in ((0, map(len, self.texts)), (1, self.counts)):
            tree = self.sums[which]
            for i, v in enumerate(values):
                tree[self.leaves + i] = v
            for i in range(self.leaves - 1, 0, -1):
                tree[i] = tree[2 * i] + tree[2 * i + 1]

    def total(self, which: int) -> int:
        return self.sums[which][1]

    def locate(self, pos: int) -> tuple[int, int]:
        """The segment that holds character ``pos`` (the last one at the end), and where it begins."""
        i, begins, tree = 1, 0, self.sums[0]
        while i < self.leaves:
            i *= 2
            if pos >= begins + tree[i]:
                begins += tree[i]
                i += 1
        i -= self.leaves
        if i >= len(self.texts):
            i = len(self.texts) - 1
            begins = self.total(0) - len(self.texts[i])
        return i, begins

    def replace(self, a: int, b: int, texts: list[str], counts: list[int]) -> None:
        """Segments ``a`` to ``b - 1`` become others; only changed paths are summed again if their number stays."""
        self.texts[a:b], self.counts[a:b] = texts, counts
        if b - a != len(texts):
            self.build()
            return
        for k in range(a, b):
            for which, v in ((0, len(self.texts[k])), (1, self.counts[k])):
                tree, i = self.sums[which], self.leaves + k
                tree[i] = v
                while i > 1:
                    i //= 2
                    tree[i] = tree[2 * i] + tree[2 * i + 1]


def safe(left: str, right: str) -> bool:
    """No pre-token crosses the place between two texts."""
    return bool(left) and bool(right) and not left[-1].isspace() and is_space(right[0])


def is_space(c: str) -> bool:
    return bool(character_classes()[ord(c)] == SPACE)


def segments(enc: Encoder, column: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """Segment texts and token counts of every text of a column."""
    for p in parts(column):
        start, before, kind, doc = enc.pieces(p.data, p.offsets)
        counts, raw = enc.counts(p.data, start), p.data.tobytes()
        running = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(doc, np.arange(p.last - p.first + 1))
        edge = (before != SPACE) & (before != 0) & (kind == SPACE)
        for d in range(p.last - p.first):
            a, b = int(first[d]), int(first[d + 1])
            cuts, good = [a], np.flatnonzero(edge[a:b]) + a
            while (k := int(np.searchsorted(good, cuts[-1] + SEGMENT))) < len(good):
                cuts.append(int(good[k]))
            cuts.append(b)
            bounds = [int(start[c]) for c in cuts[:-1] if c < b] + [int(p.offsets[d + 1])]
            yield (
                [raw[x:y].decode("utf-8") for x, y in zip(bounds[:-1], bounds[1:], strict=True)],
                [int(running[y] - running[x]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)][: len(bounds) - 1],
            )


def apply_edits(enc: Encoder, tree: CountTree, edits: list[dict]) -> int:
    """Edit the tree in order; the number of characters that were encoded again."""
    again = 0
    for e in edits:
        length = tree.total(0)
        pos = min(max(0, e["pos"] or 0), length)
        stop = min(length, pos + max(0, e["del"] or 0))
        ins = e["ins"] or ""
        if pos == stop and not ins:
            continue
        if not tree.texts:
            a = b = 0
            text = ins
        else:
            a, begins = tree.locate(pos)
            b, last = tree.locate(stop - 1) if stop > pos else (a, begins)
            head, tail = tree.texts[a][: pos - begins], tree.texts[b][stop - last :]
            b += 1
            text = head + ins + tail
        while a > 0 and not safe(tree.texts[a - 1], text):
            a -= 1
            text = tree.texts[a] + text
        while b < len(tree.texts) and not safe(text, tree.texts[b]):
            text += tree.texts[b]
            b += 1
        if len(text) <= SHORT:
            new, counts = ([text], [len(enc.bpe.encode_ordinary(text))]) if text else ([], [])
        else:
            new, counts = next(segments(enc, pa.array([text])))
        again += len(text)
        tree.replace(a, b, new, counts)
    return again


def edited_counts(docs: DataFrame, edits: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(id_col, n_tokens, n_tokens_edited, n_segments, n_chars_edited, n_chars_encoded, text_edited)`` per row.

    ``edits`` names an ``array<struct<pos,del,ins>>`` column, applied in order: at character ``pos`` of
    the text as edited so far, delete ``del`` characters and insert ``ins``. Positions beyond the text are
    moved to its end, negative ones to 0; null numbers are 0, a null insertion is empty, a null or
    empty list changes nothing. Null texts count as empty. Special tokens' strings are ordinary text here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            lists, out = batch.column(2), []
            for row, (texts, counts) in enumerate(segments(enc, batch.column(1))):
                tree = CountTree(texts, counts)
                before = tree.total(1)
                again = apply_edits(enc, tree, [x for x in lists[row].as_py() or [] if x])
                out.append((before, tree.total(1), len(tree.texts), tree.total(0), again, "".join(tree.texts)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [pa.array(c, type=pa.int64()) for c in columns[:5]] + [pa.array(columns[5], type=pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *NUMBERS, "text_edited"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} bigint" for n in NUMBERS) + ", text_edited string"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(edits).cast(EDIT_TYPE).alias("edits"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


NUMBERS = ["n_tokens", "n_tokens_edited", "n_segments", "n_chars_edited", "n_chars_encoded"]


def edited_counts_from_log(docs: DataFrame, log: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The same with edits as rows ``(id_col, seq, pos, del, ins)``, applied by ``seq`` (then pos, del, ins).

    Ids should be unique in ``docs``; rows that share one all get its edits. Edits without a document are left
    out. One document's edits are applied in order, so they meet in one row.
    """
    edit = F.struct("seq", "pos", "del", "ins")
    lists = log.groupBy(id_col).agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    plain = F.transform("edits", lambda e: F.struct(e["pos"].alias("pos"), e["del"].alias("del"), e["ins"].alias("ins")))
    both = docs.select(id_col, text_col).join(lists.select(id_col, plain.alias("edits")), id_col, "left")
    return edited_counts(both, "edits", id_col, text_col, tokenizer)
