"""Toxic spans and document scores by a linear-chain conditional random field.

Words of labelled documents are counted by class (hashed whole words, beginnings and endings, over all labelled rows).
A word's evidence, the log ratio of its shares in toxic and other documents, says which words of toxic documents
are labelled toxic, which are not, and which stay open; words of other documents are not toxic. A two-state
field over the words learns from these partly labelled chains (Tsuboi et al., 2008): features are the word's own
evidence by kind, its neighbours' and its length. Forward-backward marginals of every word then give
the spans, and their sum by document, against its length, the score.

Evidence that a document helps to count would teach the field too much trust, so it learns from each half of
the documents with the evidence of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestplane.llm.text import LOWER, Words, byte_class, distinct_pairs, parts, per_document, prefix_sums, stretch_hash, tidy, words
from nestplane.sources.shared import Workspace

BITS = 20
#: Kinds of hashed features: bytes of a word's beginning (0: the whole word), or of its end if negative.
KINDS = (0, 3, 4, 5, 6, 8, -5)
EDGES = np.array([-2.0, -0.5, 0.5, 1.5, 2.5, 3.5, 5.0])  # of the bins of evidence
LEVELS = len(EDGES) + 1
LENGTHS = np.array([3, 6, 10])  # of the bins of word length
SHRINK = 10  # documents' worth of prior on a feature's class shares
#: In a toxic document, words with at least ``SURE`` evidence are labelled toxic, those under ``CLEAR`` not toxic.
SURE, CLEAR = 2.5, 0.5
#: Documents that the field and the score's weights are fitted on, by hash of the id; words are counted over all.
SAMPLE = 12_000
#: Of these, documents of either class whose chains the field learns from.
CHAINS = 500
STEPS = 40
LANE = 64  # words of a lane of the scans
BROADCAST_IDS = 4_000_000

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
INNER = byte_class(range(0x80, 0xC0))  # bytes inside a character

#: Of each one-hot feature group: its first weight.
OWN = [k * LEVELS for k in range(len(KINDS))]
BEFORE, AFTER, LONG = (len(KINDS) * LEVELS, (len(KINDS) + 1) * LEVELS, (len(KINDS) + 2) * LEVELS)
WEIGHTS = LONG + len(LENGTHS) + 1
GROUPS = len(KINDS) + 3


# --- features -----------------------------------------------------------------------------------


class Chain(NamedTuple):
    """Words of some texts: where they are and their hashed features, one row a kind."""

    words: Words
    hashed: np.ndarray


def read(data: np.ndarray, offsets: np.ndarray) -> Chain:
    low = LOWER[data]
    w = words(low, offsets, LETTER)
    return Chain(w, hashed_words(w, prefix_sums(low)))


def hashed_words(w: Words, sums: np.ndarray) -> np.ndarray:
    """Hashed features of the words of a lower-case text with the prefix sums ``sums``, one row a kind."""
    hashed = np.empty((len(KINDS), len(w.doc)), dtype=np.int32)
    for k, size in enumerate(KINDS):
        start = np.maximum(w.start, w.end + size) if size < 0 else w.start
        end = np.minimum(w.end, w.start + size) if size > 0 else w.end
        h = stretch_hash(sums, start, end)
        h += np.uint64(k)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(64 - BITS)
        hashed[k] = h
    return hashed


def codes(chain: Chain, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(groups, words)`` numbers of each word's one-hot features, and its greatest evidence."""
    w, out = chain.words, np.empty((GROUPS, chain.hashed.shape[1]), dtype=np.uint8)
    top = np.full(chain.hashed.shape[1], -np.inf, dtype=np.float32)
    for k, row in enumerate(chain.hashed):
        found = evidence[row]
        out[k] = OWN[k] + np.searchsorted(EDGES, found, side="right")
        np.maximum(top, found, out=top)
    level = np.searchsorted(EDGES, top, side="right").astype(np.uint8)
    none = np.searchsorted(EDGES, 0.0).astype(np.uint8)
    before, after = np.full(len(top), none, np.uint8), np.full(len(top), none, np.uint8)
    before[1:], after[:-1] = level[:-1], level[1:]
    first = w.first[:-1][w.first[:-1] < w.first[1:]]
    last = w.first[1:][w.first[:-1] < w.first[1:]] - 1
    before[first], after[last] = none, none
    out[-3], out[-2] = BEFORE + before, AFTER + after
    out[-1] = LONG + np.searchsorted(LENGTHS, w.end - w.start)
    return out, top


# --- the field ----------------------------------------------------------------------------------


class Field(NamedTuple):
    """Weights of the features for the state 1 (toxic) against 0, of its start, and of the four transitions."""

    features: np.ndarray
    start: float
    moves: np.ndarray  # (2, 2), log


class Links(NamedTuple):
    """Per word, the field's factors from its predecessor's state to its own: rows from 0 and 1, as four columns."""

    stay: np.ndarray
    enter: np.ndarray
    leave: np.ndarray
    keep: np.ndarray


def links(odds: np.ndarray, first: np.ndarray, field: Field) -> Links:
    """Factors of words whose features favour the state 1 by ``odds`` (log). A document's first word has the same factors from either state."""
    e, move = np.exp(np.clip(odds, -60, 60)), np.exp(field.moves)
    begin = np.exp(np.clip(field.start, -60, 60)) * e
    return Links(
        np.where(first, 1.0, move[0, 0]), np.where(first, begin, move[0, 1] * e), np.where(first, 1.0, move[1, 0]), np.where(first, begin, move[1, 1] * e)
    )


def ratios(start: float, m: Links) -> np.ndarray:
    """Ratio of state 1 to state 0 before the first and after each of a chain of links: ``(n + 1,)``.

    Long chains are cut into lanes: products of all lanes go step by step together, the lanes' own chain comes next, and the
    ratios inside all lanes last.
    """
    n = len(m.stay)
    if n <= LANE:
        out = [start]
        for a, b, c, d in zip(*(x.tolist() for x in m), strict=True):
            out.append((b + out[-1] * d) / (a + out[-1] * c))
        return np.array(out)
    lanes = -(-n // LANE)
    neutral = (1.0, 0.0, 0.0, 1.0)
    cut = [np.ascontiguousarray(np.concatenate([x, np.full(lanes * LANE - n, e)]).reshape(lanes, LANE).T) for x, e in zip(m, neutral, strict=True)]
    a, b, c, d = (x[0] for x in cut)
    for k in range(1, LANE):
        p, q, r, s = (x[k] for x in cut)
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    out = np.empty((LANE + 1, lanes))
    out[0] = ratios(start, Links(a, b, c, d))[:-1]
    for k in range(LANE):
        p, q, r, s = (x[k] for x in cut)
        out[k + 1] = (q + out[k] * s) / (p + out[k] * r)
    return np.concatenate([[start], out[1:].T.ravel()[:n]])


def beliefs(odds: np.ndarray, first: np.ndarray, field: Field, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the state 1 by forward-backward over documents laid end to end, and expected transitions inside them.

    ``first`` marks each document's first word. The transitions, ``(2, 2)``, are zeros unless asked for.
    """
    both = np.zeros((2, 2))
    if not len(odds):
        return np.zeros(0), both
    m = links(odds, first, field)
    forward = ratios(1.0, m)
    # backward messages stop at a first word, whose factors do not depend on the state before
    back = ratios(1.0, Links(*(x[::-1] for x in (m.stay, m.leave, m.enter, m.keep))))[::-1]
    joint = np.minimum(forward[1:] * back[1:], 1e300)
    marginal = joint / (1 + joint)
    if pairs:
        r, b = forward[:-1][~first], back[1:][~first]
        each = [x[~first] * y for x, y in zip(m, (1.0, b, r, r * b), strict=True)]
        size = sum(each)
        both = np.array([(x / size).sum() for x in each]).reshape(2, 2)
    return marginal, both


def emission(code: np.ndarray, field: Field) -> np.ndarray:
    """Log odds of state 1 from the features of each column of ``code``."""
    out = np.zeros(code.shape[1])
    for row in code:
        out += field.features[row]
    return out


def fit_field(code: np.ndarray, first: np.ndarray, allowed: np.ndarray, steps: int = STEPS, ridge: float = 1.0) -> Field:
    """The field under which partly labelled chains are likeliest, by gradient steps scaled per weight.

    ``allowed`` is ``(words, 2)``: states a word may have. The gradient is the expected counts under the allowed
    states less those under all.
    """
    w = np.zeros(WEIGHTS + 5)
    w[-4:], w[-5] = np.log([0.99, 0.01, 0.5, 0.5]), -4.0
    mean, square, rest = np.zeros_like(w), np.zeros_like(w), w.copy()
    shut = np.where(allowed[:, 0], 0.0, 60.0) - np.where(allowed[:, 1], 0.0, 60.0)
    kinds, same = np.unique(code, axis=1, return_inverse=True)
    same = same.ravel()
    for t in range(1, steps + 1):
        field = as_field(w)
        odds = emission(kinds, field)[same]
        free, held = beliefs(odds, first, field, pairs=True), beliefs(odds + shut, first, field, pairs=True)
        more = held[0] - free[0]
        by_kind, slope = np.bincount(same, more, kinds.shape[1]), np.zeros_like(w)
        for row in kinds:
            slope[:WEIGHTS] += np.bincount(row, by_kind, WEIGHTS)
        slope[WEIGHTS], slope[-4:] = more[first].sum(), (held[1] - free[1]).ravel()
        slope = (slope - ridge * (w - rest)) / max(1, len(first))
        mean, square = 0.9 * mean + 0.1 * slope, 0.98 * square + 0.02 * slope * slope
        w = w + 0.3 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.98**t)) + 1e-9) * min(1.0, 2 * (1 - t / (steps + 1)))
    return as_field(w)


def as_field(w: np.ndarray) -> Field:
    return Field(w[:WEIGHTS], float(w[WEIGHTS]), w[-4:].reshape(2, 2))


# --- documents ----------------------------------------------------------------------------------


class Model(NamedTuple):
    evidence: np.ndarray  # (2**BITS,)
    field: Field
    weights: np.ndarray  # of the sums of marginals; empty without a field
    prior: float  # score of every document where the labels know one class only


def sums_of(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document (``first``: first word of each, then their number): sums that its score follows from, and 1."""
    n, total = np.diff(first), np.clip(per_document(marginal, first), 0, None)
    steps = [np.clip(total - k, 0, 1) for k in range(3)]
    return np.column_stack([*steps, np.log1p(total), np.sqrt(total / np.maximum(n, 1)), np.log1p(n) / 10, np.ones(len(n))])


def starts(w: Words) -> np.ndarray:
    out = np.zeros(len(w.doc), dtype=bool)
    out[w.first[:-1][w.first[:-1] < w.first[1:]]] = True
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose labels are not learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def word_counts(known: DataFrame) -> DataFrame:
    """``(feature, c array<bigint>)``: documents with a feature by half and class, from ``(half, toxic, text)``.

    A task counts in arrays and emits what is not zero; ``feature`` -1 is the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((1 << BITS, 4), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            cell = 2 * batch.column(0).to_numpy() + batch.column(1).to_numpy()
            docs += np.bincount(cell, minlength=4)
            for p in parts(batch.column(2)):
                chain = read(p.data, p.offsets)
                doc, feature = distinct_pairs(chain.words.doc, chain.hashed, BITS)
                np.add.at(counts.reshape(-1), 4 * feature + cell[p.first : p.last][doc], 1)
        used = np.flatnonzero(counts.any(axis=1))
        flat = np.concatenate([docs, counts[used].ravel()])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), 4).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], used])), lists], names=["feature", "c"])

    found = known.select("half", "toxic", "text").mapInArrow(tidy(run), "feature bigint, c array<bigint>")
    return found.groupBy("feature").agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(4)]).alias("c"))


def log_ratios(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Evidence of each feature from ``(features, 2)`` documents of class 0 and 1; rare ones are shrunk to 0."""
    zero, one = np.maximum(docs.astype(np.float64), 1)
    k = SHRINK / (zero + one)
    return (np.log((counts[:, 1] + k * one) / one) - np.log((counts[:, 0] + k * zero) / zero)).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, half, toxic, text)`` of documents with a label; several labels of an id count by their worst."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("toxic is not null")
    known = known.withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(known, "id").select("id", "half", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model of labelled documents (``labels``: ``id_col``, ``toxic`` 0/1; null labels are none).

    Words are counted over all of them, every row of a repeated id; the field and the weights of the score come from at most ``sample`` ids, whole, of a
    repeated id its smallest text. Labels of one class only, or none, give a model whose score is that class (0).
    """
    space = Workspace(docs.sparkSession, "toxicity")
    known = labelled(docs, labels, id_col, text_col)
    table = space.write(word_counts(known), "counts").toArrow()  # 2**BITS rows at most
    feature, c = table["feature"].to_numpy(), table["c"].combine_chunks().flatten().to_numpy().reshape(-1, 4)
    number = c[feature < 0].sum(axis=0)
    by = np.zeros((1 << BITS, 4), np.int64)
    by[feature[feature >= 0]] = c[feature >= 0]
    both = number[:2] + number[2:]
    if not both.all():
        return Model(np.zeros(0, np.float32), as_field(np.zeros(WEIGHTS + 5)), np.zeros(0), float(both[1] > 0))
    halves = [log_ratios(by[:, 2 * h : 2 * h + 2], number[2 * h : 2 * h + 2]) if number[2 * h : 2 * h + 2].all() else log_ratios(by[:, :2] + by[:, 2:], both) for h in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(halves)
    one = known.groupBy("id").agg(F.first("half").alias("half"), F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    chosen = known.select("id").distinct().orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample)
    one = one.join(F.broadcast(chosen), "id", "left_semi")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, half = [], batch.column(0).to_numpy()
            for p in parts(batch.column(2)):
                chain = read(p.data, p.offsets)
                other = 1 - half[p.first : p.last]
                code, top = codes(chain, shared.value[0])
                second = other[chain.words.doc] == 1
                if second.any():
                    code1, top1 = codes(chain, shared.value[1])
                    code, top = np.where(second, code1, code), np.where(second, top1, top)
                limits = chain.words.first
                out += [(code[:, a:b].T.tobytes(), top[a:b].astype(np.float32).tobytes()) for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["toxic", "code", "top"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        w = learn(rows)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["w"])

    features = space.write(one.select("half", "toxic", "text").mapInArrow(tidy(featured), "toxic int, code binary, top binary"), "features")
    w = np.array(features.coalesce(1).mapInArrow(tidy(trained), "w array<double>").first()["w"])
    shared.destroy()
    return Model(log_ratios(by[:, :2] + by[:, 2:], both), as_field(w[: WEIGHTS + 5]), w[WEIGHTS + 5 :], 0.0)


def learn(rows: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Weights of the field, then of the document's sums, from ``(toxic, codes, evidence)`` of the sample."""
    y = np.array([r[0] for r in rows])
    chosen = np.concatenate([np.flatnonzero(y == c)[:CHAINS] for c in (0, 1)])
    code, top, size = [], [], []
    for i in chosen:
        top.append(np.frombuffer(rows[i][2], np.float32))
        code.append(np.frombuffer(rows[i][1], np.uint8).reshape(-1, GROUPS))
        size.append(len(top[-1]))
    code, top, size = np.concatenate(code).T, np.concatenate(top), np.array(size)
    ends = np.cumsum(size)
    first = np.zeros(len(top), dtype=bool)
    first[(ends - size)[size > 0]] = True
    toxic = np.repeat(y[chosen] == 1, size)
    allowed = np.column_stack([~toxic | (top < SURE), toxic & (top >= CLEAR)])
    w = np.zeros(WEIGHTS + 5)
    if len(first):
        field = fit_field(code, first, allowed)
        w = np.concatenate([field.features, [field.start], field.moves.ravel()])
    field, seen = as_field(w), []
    for k in range(0, len(rows), 500):
        own = rows[k : k + 500]
        limits = np.concatenate([[0], np.cumsum([len(r[1]) // GROUPS for r in own])]).astype(np.int64)
        code = np.frombuffer(b"".join(r[1] for r in own), np.uint8).reshape(-1, GROUPS).T
        first = np.zeros(code.shape[1], dtype=bool)
        first[limits[:-1][np.diff(limits) > 0]] = True
        seen.append(sums_of(beliefs(emission(code, field), first, field)[0], limits))
    return np.concatenate([w, logistic(np.concatenate(seen), y.astype(np.float64))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Weights of a small ridge logistic regression by Newton steps."""
    v = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        slope = x.T @ (p - y) + ridge * v
        v = v - np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(len(v)), slope)
    return v


def spans_of(marginal: np.ndarray, w: Words, data: np.ndarray, offsets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, end)`` of runs of words with a marginal of ``least`` or more, in code points of the text."""
    on = marginal >= least
    begins, ends = on.copy(), on.copy()
    same = w.doc[1:] == w.doc[:-1]
    begins[1:] &= ~(on[:-1] & same)
    ends[:-1] &= ~(on[1:] & same)
    points = np.concatenate([[0], np.cumsum(~INNER[data])])
    doc = w.doc[begins]
    return doc, points[w.start[begins]] - points[offsets[doc]], points[w.end[ends]] - points[offsets[doc]]


def scored(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) and ``toxic_spans``, an array of ``(start, end, score)`` in code points.

    Columns of these names, in any case, are replaced. A span is a run of words whose marginals reach ``least``; its score is its
    greatest marginal. A null text counts as empty; a text without words has the score of its lack of words, and no span.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("toxic_score", "toxic_spans")]
    at = kept.index(text_col)
    schema = docs.select(*kept).schema.add("toxic_score", "double").add("toxic_spans", T.ArrayType(SPAN))
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, field, weights, prior = shared.value
        for batch in batches:
            score, found, sizes = np.full(batch.num_rows, prior), [], np.zeros(batch.num_rows, dtype=np.int64)
            for p in parts(batch.column(at)) if len(weights) else ():
                chain = read(p.data, p.offsets)
                code, _ = codes(chain, evidence)
                marginal, _ = beliefs(emission(code, field), starts(chain.words), field)
                score[p.first : p.last] = 1 / (1 + np.exp(-np.clip(sums_of(marginal, chain.words.first) @ weights, -500, 500)))
                doc, start, end = spans_of(marginal, chain.words, p.data, p.offsets, least)
                sizes[p.first : p.last] = np.bincount(doc, minlength=p.last - p.first)
                if len(doc):
                    on = np.where(marginal >= least, marginal, 0.0)
                    edge = np.flatnonzero((on > 0) & np.concatenate([[True], (on[:-1] == 0) | (chain.words.doc[1:] != chain.words.doc[:-1])]))
                    found.append((start, end, np.maximum.reduceat(on, edge)))
            joined = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3)]
            values = pa.StructArray.from_arrays([pa.array(joined[0].astype(np.int32)), pa.array(joined[1].astype(np.int32)), pa.array(joined[2].astype(np.float64))], fields=list(kind))
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), spans], names=[*kept, "toxic_score", "toxic_spans"])

    return docs.select(*kept).mapInArrow(tidy(run), schema)
