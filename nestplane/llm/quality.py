"""Weak-label quality model.

Heuristic labellers vote good, bad or nothing on every document, several of them on either question; human labels, where there are any, are
one more labeller. Expectation-maximisation over the counts of vote patterns of all documents estimates how
often each labeller is right on either class. The posterior labels of a bounded sample train a linear
scorer over hashed word beginnings and style features, which then scores every document from its text
alone. Two such models are kept: low quality and toxicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestplane.llm import toxicity
from nestplane.llm.text import LOWER, Words, byte_class, distinct_pairs, parts, per_document, prefix_sums, stretch_hash, tidy, words
from nestplane.sources.shared import Workspace

TASKS = ("low", "toxic")
BITS = 18
PREFIXES = (6, 8, 11, 1 << 30)  # bytes of a word's beginning; the last is the whole word
#: Documents the scorer learns from: human-labelled ones first, then by hash of the id.
SAMPLE = 12_000
ROUNDS = 25  # Newton steps
TOGETHER = 500  # documents whose features are counted at once
SHRINK = 10  # documents' worth of prior on a feature's class shares
STRENGTHS = (0.0, 1.0, 2.0)  # evidence counted from these sizes on
HUMAN = 0.995  # how often a human label is right
#: Insults that one labeller looks for (plain lexicon of four languages; parameter of ``votes``).
INSULTS = (
    "asshole bastard bitch clown coward creep degenerate disgusting dumb dumbass fool freak idiot imbecile jerk liar loser lunatic moron"
    " pathetic pig retard scum scumbag stupid trash twat vermin worthless"
    " abschaum arschloch dreckig dummkopf dumm feigling idioten miststück schwachkopf schwein trottel vollidiot widerlich"
    " abruti connard connasse crétin débile imbécile lâche minable ordure salaud salope stupide"
    " asqueroso basura cabrón capullo cobarde escoria estúpido gilipollas idiota imbécil inútil payaso"
).split()
#: Words that address the reader (plain list of four languages).
ADDRESS = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous vos tú ti tus eres usted ustedes".split()
NEAR = 4  # words between an address and an insult

LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
UPPER, DIGIT = byte_class(range(0x41, 0x5B)), byte_class(range(0x30, 0x3A))
BLANK = byte_class([0x20, *range(0x09, 0x0E)])
SYMBOL = ~(LETTER | DIGIT | BLANK | byte_class(b".,;:'\"-()?!"))
TOKEN = ~BLANK

#: Labellers: task, style feature, vote 1 (bad) beyond the one, 0 (good) under the other limit, nothing between.
RULES = (
    ("low", "symbols", 0.10, 0.04),
    ("low", "lone_marks", 0.20, 0.05),
    ("low", "upper", 0.50, 0.15),
    ("low", "repeated", 0.65, 0.40),
    ("low", "stutter", 0.15, 0.05),
    ("low", "shouts", 0.30, 0.10),
    ("toxic", "insults", 0.001, None),
)
#: More labellers of toxicity, which overlap: insults near an address, shouting, and words that human labels show to be toxic (two or more; none is a vote for good). A
#: labeller without a limit for good never votes it: the lexicons do not know every language.
OVERLAPPING = (
    ("toxic", "addressed", 0.001, None),
    ("toxic", "shouts", 0.30, None),
    ("toxic", "learned", 0.50, 0.0),
)
LABELLERS = RULES + OVERLAPPING
STYLE = ("symbols", "lone_marks", "upper", "digits", "repeated", "stutter", "shouts", "insults", "learned")


class Looked(NamedTuple):
    words: Words
    sums: np.ndarray  # prefix sums of the lower-case text
    hashed: np.ndarray  # of each whole word
    style: dict[str, np.ndarray]


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def look(data: np.ndarray, offsets: np.ndarray, insults: list[str], learned: np.ndarray | None = None) -> Looked:
    """Words (between white space) and style shares of some texts. ``learned`` marks hashed word features that human labels show to be toxic."""
    low = LOWER[data]
    w, core = words(low, offsets, TOKEN), words(low, offsets, LETTER)
    n, sums = np.diff(w.first), prefix_sums(low)
    count = lambda places: np.diff(np.searchsorted(places, offsets))
    upper = np.flatnonzero(UPPER[data])
    letters = per_document(core.end - core.start, core.first)
    lone = np.ones(len(w.doc), dtype=bool)  # a run of letters lies inside one word
    lone[np.searchsorted(w.start, core.start, side="right") - 1] = False
    h = stretch_hash(sums, w.start, w.end)
    distinct = distinct_hashes(h, w)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    bang = np.flatnonzero(data[w.end - 1] == 0x21) if len(h) else np.zeros(0, np.int64)
    shouted = bang[np.searchsorted(upper, w.end[bang]) - np.searchsorted(upper, w.start[bang]) > 1]
    named = stretch_hash(sums, core.start, core.end)
    rude, told = among(named, word_set(insults)), among(named, word_set(ADDRESS))
    close = np.zeros(len(rude), dtype=bool)
    for k in range(1, NEAR + 1):
        same_text = core.doc[k:] == core.doc[:-k]
        close[k:] |= rude[k:] & told[:-k] & same_text
        close[:-k] |= rude[:-k] & told[k:] & same_text
    hits = np.zeros(len(n))
    if learned is not None:
        hits = per_document(learned[toxicity.hashed_words(core, sums)].any(axis=0), core.first)
    # a short text repeats little by chance; a long one repeats its common words
    expected = np.minimum(1.0, 1.2 * np.maximum(n, 1) ** -0.12)
    style = {
        "symbols": share(count(np.flatnonzero(SYMBOL[data])), np.diff(offsets)),
        "lone_marks": share(per_document(lone, w.first), n),
        "upper": share(count(upper), letters),
        "digits": share(count(np.flatnonzero(DIGIT[data])), np.diff(offsets)),
        "repeated": np.where(n >= 8, 1 - np.minimum(1.0, share(distinct, n) / expected), 0.0),
        "stutter": share(per_document(same, w.first), n),
        "shouts": share(np.bincount(w.doc[shouted], minlength=len(n)), n),
        "insults": share(per_document(rude, core.first), np.diff(core.first)),
        "addressed": share(per_document(close, core.first), np.diff(core.first)),
        "learned": np.minimum(hits, 4) / 4,
    }
    return Looked(w, sums, h, style)


def distinct_hashes(h: np.ndarray, w: Words) -> np.ndarray:
    """Distinct words of each text; the sorted keys hold the text in their first bits and the rest of the hash."""
    n = len(w.first) - 1
    bits = np.uint64(max(1, n.bit_length()))
    key = w.doc.astype(np.uint64) << (np.uint64(64) - bits)
    key |= h >> bits
    key.sort()
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return per_document(new, w.first)  # sorted by text, so each text's keys stand where its words did


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is one of the few ``known``; only those that share their first 16 bits with one are compared."""
    first, out = np.zeros(1 << 16, dtype=bool), np.zeros(len(h), dtype=bool)
    first[known >> np.uint64(48)] = True
    near = np.flatnonzero(first[h >> np.uint64(48)])
    out[near] = np.isin(h[near], known)
    return out


def word_set(items: list[str]) -> np.ndarray:
    raw = [x.encode() for x in items]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    return stretch_hash(prefix_sums(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def votes(docs: DataFrame, id_col: str, text_col: str, insults: list[str], learned: np.ndarray | None = None) -> DataFrame:
    """``(id, votes array<tinyint>)``: per labeller 1, 0, or -1 for none. Texts without words get no vote, nor does any from a
    labeller that has learned nothing."""
    known = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, len(LABELLERS)), -1, dtype=np.int8)
            for p in parts(batch.column(1)):
                seen = look(p.data, p.offsets, insults, known.value)
                some = np.diff(seen.words.first) > 0
                for k, (_, feature, bad, good) in enumerate(LABELLERS):
                    if feature != "learned" or known.value is not None:
                        v = seen.style[feature]
                        rest = -1 if good is None else np.where(v <= good, 0, -1)
                        out[p.first : p.last, k] = np.where(~some, -1, np.where(v >= bad, 1, rest))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(LABELLERS), dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, votes array<tinyint>")


class WeakModel(NamedTuple):
    """Per task: the prior of class 1, and per labeller the chance of each vote given the class."""

    prior: dict[str, float]
    tables: dict[str, np.ndarray]  # (labellers, class, vote -1/0/1)
    columns: dict[str, list[int]]

    def posterior(self, task: str, patterns: np.ndarray) -> np.ndarray:
        t, cols = self.tables[task], self.columns[task]
        score = np.log([1 - self.prior[task], self.prior[task]])[None, :].repeat(len(patterns), 0)
        for k, c in enumerate(cols):
            score += np.log(t[k][:, patterns[:, c] + 1]).T
        human = patterns[:, cols[-1]]  # decides where there is one: the rules' votes are not independent enough to outweigh it
        return np.where(human >= 0, np.where(human == 1, HUMAN, 1 - HUMAN), 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500))))


def accuracies(patterns: np.ndarray, weights: np.ndarray, steps: int = 50, labellers: tuple = RULES) -> WeakModel:
    """EM over vote patterns (one row each) with their numbers of documents.

    Columns are the ``labellers`` and then the human labels of either task. It starts from labellers that are
    right nine times in ten; each class keeps a pseudo-count, so no chance becomes 0. The human labeller's
    accuracy is given (``HUMAN``), not estimated: it says which of the hidden classes is meant.
    """
    prior, tables, columns = {}, {}, {}
    for t, task in enumerate(TASKS):
        cols = [k for k, r in enumerate(labellers) if r[0] == task] + [len(labellers) + t]
        v = patterns[:, cols]
        spoken = (v >= 0).mean(axis=0).clip(0.05, 0.95)
        table = np.zeros((len(cols), 2, 3))
        for k in range(len(cols)):
            for c in (0, 1):
                table[k, c] = [1 - spoken[k], spoken[k] * (0.9, 0.1)[c], spoken[k] * (0.1, 0.9)[c]]
        right = HUMAN
        table[-1] = [[1 / 3, 2 / 3 * right, 2 / 3 * (1 - right)], [1 / 3, 2 / 3 * (1 - right), 2 / 3 * right]]
        prior[task], tables[task], columns[task] = 0.15, table, cols
        for _ in range(steps):
            p = WeakModel(prior, tables, columns).posterior(task, patterns)
            for c, own in ((0, weights * (1 - p)), (1, weights * p)):
                for k in range(len(cols) - 1):
                    tables[task][k, c] = (np.bincount(v[:, k] + 1, own, 3) + 0.5) / (own.sum() + 1.5)
            prior[task] = float(np.clip((weights * p).sum() / weights.sum(), 0.001, 0.999))
    return WeakModel(prior, tables, columns)


def style_columns(style: dict[str, np.ndarray]) -> np.ndarray:
    """Style shares on a scale where small differences near 0 count."""
    every = [np.sqrt(np.clip(style[s], 0, 1)) for s in STYLE]
    return np.stack([*every, (style["insults"] > 0).astype(float), (style["learned"] > 0.25).astype(float)], axis=1).astype(np.float32)


def features(seen: Looked) -> tuple[np.ndarray, np.ndarray]:
    """``(document, hashed feature)`` of the distinct word beginnings of each text."""
    w = seen.words
    size, doc, found = w.end - w.start, [], []
    for k, most in enumerate(PREFIXES):
        if most > 1 << 20:
            doc.append(w.doc)
            h = seen.hashed + np.uint64(k)
        else:
            long = np.flatnonzero(size >= most)
            start = w.start[long]
            doc.append(w.doc[long])
            h = stretch_hash(seen.sums, start, start + most) + np.uint64(k)
        found.append(h >> np.uint64(64 - BITS))
    return distinct_pairs(np.concatenate(doc), np.concatenate(found), BITS)


class Scorer(NamedTuple):
    hashed: np.ndarray  # (tasks, 2**BITS)
    style: np.ndarray  # (tasks, style)
    bias: np.ndarray
    learned: np.ndarray | None = None  # hashed word features that human labels show to be toxic

    def scores(self, seen: Looked) -> np.ndarray:
        n = len(seen.words.first) - 1
        doc, f = features(seen)
        number = np.bincount(doc, minlength=n)
        out = style_columns(seen.style) @ self.style.T + self.bias
        for t in range(len(TASKS)):
            out[:, t] += np.bincount(doc, self.hashed[t][f], minlength=n) / np.sqrt(np.maximum(number, 1))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def stretches(sample: list, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sample's ``rows`` some at a time: their numbers, all their features, and the row of each feature."""
    for k in range(0, len(rows), TOGETHER):
        own = rows[k : k + TOGETHER]
        yield own, np.concatenate([sample[i][0] for i in own]), np.repeat(np.arange(len(own)), [len(sample[i][0]) for i in own])


def evidence(sample: list, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log ratio of each hashed feature's share of class 1 and class 0 in some rows, shrunk to 0 where it is rare."""
    one, zero = y[rows].sum(), (1 - y[rows]).sum()
    if one <= 0 or zero <= 0:
        return np.zeros(1 << BITS)
    have, lack = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for own, f, at in stretches(sample, rows):
        have += np.bincount(f, y[own][at], 1 << BITS)
        lack += np.bincount(f, 1 - y[own][at], 1 << BITS)
    k = SHRINK / (one + zero)
    return np.log((have + k * one) / one) - np.log((lack + k * zero) / zero)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a small ridge logistic regression by Newton steps; the last column should be ones."""
    v = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * v
        v = v - np.linalg.solve((x.T * (weight * (p * (1 - p) + 1e-6))) @ x + ridge * np.eye(len(v)), slope)
    return v


def learn(sample: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Scorer:
    """A linear scorer from ``(features, style, posteriors)`` of the sample.

    Hashed weights are the features' evidence in up to three strengths; how much each strength and each style
    column counts is fitted on the halves of the sample that the evidence was not taken from.
    """
    n = len(sample)
    style, target = np.stack([s for _, s, _ in sample]).astype(np.float64), np.stack([p for _, _, p in sample]).astype(np.float64)
    norm = np.sqrt([max(1, len(f)) for f, _, _ in sample])
    out = Scorer(np.zeros((len(TASKS), 1 << BITS), np.float32), np.zeros((len(TASKS), style.shape[1]), np.float32), np.zeros(len(TASKS), np.float32))
    halves = np.arange(0, n, 2), np.arange(1, n, 2)
    for t in range(len(TASKS)):
        y = target[:, t]
        sums = np.zeros((n, len(STRENGTHS)))
        for taken, judged in (halves, halves[::-1]):
            r = evidence(sample, taken, y)
            for own, f, at in stretches(sample, judged):
                for k, least in enumerate(STRENGTHS):
                    sums[own, k] = np.bincount(at, np.where(np.abs(r) >= least, r, 0)[f], minlength=len(own)) / norm[own]
        weight = np.abs(2 * y - 1)  # undecided posteriors teach little
        v = logistic(np.column_stack([sums, style, np.ones(n)]), (y > 0.5).astype(float), weight)
        r = evidence(sample, np.arange(n), y)
        out.hashed[t] = sum(v[k] * np.where(np.abs(r) >= least, r, 0) for k, least in enumerate(STRENGTHS))
        out.style[t], out.bias[t] = v[len(STRENGTHS) : -1], v[-1]
    return out


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", insults: list[str] | None = None, sample: int = SAMPLE) -> Scorer | None:
    """The scorer of a corpus; null if it has no document with a word.

    ``labels`` (``id_col, quality 0/1, toxic 0/1``) may cover any part of the documents or be absent; several labels
    of one document count by their worst. Vote patterns are counted over all documents; the scorer learns
    from at most ``sample`` ids, whole, and of a repeated id from the text with the least hash.
    """
    spark, insults = docs.sparkSession, list(insults or INSULTS)
    space = Workspace(spark, "quality")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row", F.xxhash64("text"))
    learned = None if labels is None else toxic_features(docs, labels, id_col, text_col, space)
    votes_of = votes(texts.select(F.struct("id", "row").alias("key"), "text"), "key", "text", insults, learned).select("id.id", "id.row", "votes")
    if labels is not None:
        low, toxic = (1 - F.col("quality")).cast("tinyint"), F.col("toxic").cast("tinyint")
        known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(low).alias("low"), F.max(toxic).alias("toxic"))
        votes_of = votes_of.join(known, "id", "left")
    else:
        votes_of = votes_of.withColumns({"low": F.lit(None).cast("tinyint"), "toxic": F.lit(None).cast("tinyint")})
    none = F.lit(-1).cast("tinyint")
    both = F.concat("votes", F.array(F.coalesce("low", none), F.coalesce("toxic", none)))
    voted = space.write(votes_of.select("id", "row", both.alias("pattern")), "votes")
    counts = voted.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    if not counts:
        return None
    patterns = np.array([r["pattern"] for r in counts], dtype=np.int64)
    weak = accuracies(patterns, np.array([r["count"] for r in counts], dtype=np.float64), labellers=LABELLERS)
    post = np.stack([weak.posterior(t, patterns) for t in TASKS], axis=1)
    named = spark.createDataFrame([(list(r["pattern"]), p.tolist()) for r, p in zip(counts, post, strict=True)], "pattern array<tinyint>, target array<double>")
    human = F.greatest(F.element_at("pattern", -1), F.element_at("pattern", -2)) >= 0
    single = voted.groupBy("id").agg(F.min(F.struct("row", "pattern")).alias("first")).select("id", "first.*")
    chosen = single.orderBy(F.desc(human), F.xxhash64("id"), "id").limit(sample).join(F.broadcast(named), "pattern").select("id", "row", "target")
    chosen = space.write(chosen, "chosen")
    rows = texts.join(F.broadcast(chosen), ["id", "row"]).groupBy("id").agg(F.first("text").alias("text"), F.first("target").alias("target"))

    known = spark.sparkContext.broadcast(learned)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, s = [], []
            for p in parts(batch.column(1)):
                seen = look(p.data, p.offsets, insults, known.value)
                doc, hashed = features(seen)
                cuts = np.searchsorted(doc, np.arange(p.last - p.first + 1))
                f += [hashed[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                s += list(style_columns(seen.style))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), pa.array(s, pa.list_(pa.float32())), batch.column(2), batch.column(0)], names=["f", "s", "target", "key"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [
            (key, f, s, p)
            for batch in batches
            for key, f, s, p in zip(batch.column(3).to_pylist(), *[[np.asarray(x.values) for x in batch.column(k)] for k in range(3)], strict=True)
        ]
        held.sort(key=lambda r: r[0])  # however the rows lie, the halves are the same
        got = learn([r[1:] for r in held]) if held else None
        flat = [got.hashed[t].tobytes() for t in range(len(TASKS))] if got else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat, pa.binary()), pa.array([x.tolist() for x in got.style] if got else [], pa.list_(pa.float32())), pa.array(got.bias if got else [], pa.float32())],
            names=["hashed", "style", "bias"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    features_of = space.write(rows.select("id", "text", "target").mapInArrow(tidy(featured), f"f array<int>, s array<float>, target array<double>, key {kind}"), "features")
    got = features_of.coalesce(1).mapInArrow(tidy(trained), "hashed binary, style array<float>, bias float").collect()
    if not got:
        return None
    return Scorer(np.stack([np.frombuffer(r["hashed"], np.float32) for r in got]), np.array([r["style"] for r in got], np.float32), np.array([r["bias"] for r in got], np.float32), learned)


def toxic_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, space: Workspace) -> np.ndarray | None:
    """Whether each hashed feature of a word (``toxicity.KINDS``) is far likelier in documents that people labelled toxic; null without both classes."""
    found = space.write(toxicity.word_counts(toxicity.labelled(docs, labels, id_col, text_col)), "words")
    totals = found.where("feature < 0").first()
    if totals is None:
        return None
    number = [totals["c"][t] + totals["c"][t + 2] for t in (0, 1)]
    if not all(number):
        return None
    k = toxicity.SHRINK / sum(number)
    share = [F.log((F.get("c", F.lit(t)) + F.get("c", F.lit(t + 2)) + k * number[t]) / number[t]) for t in (0, 1)]
    sure = found.where((F.col("feature") >= 0) & (share[1] - share[0] >= toxicity.SURE)).select("feature").toArrow()  # 2**BITS rows at most, few in practice
    out = np.zeros(1 << toxicity.BITS, dtype=bool)
    out[sure["feature"].to_numpy()] = True
    return out


def scored(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", insults: list[str] | None = None) -> DataFrame:
    """``docs`` with ``low_score`` and ``toxic_score``, both 0 to 1 (columns of these names, in any case, are replaced).

    A null text or one without words scores ``low_score`` 1 and ``toxic_score`` 0, as does any text without a scorer.
    """
    shared, insults = docs.sparkSession.sparkContext.broadcast(scorer), list(insults or INSULTS)
    names = [f"{t}_score" for t in TASKS]
    kept = [c for c in docs.columns if c.lower() not in names]
    at = kept.index(text_col)
    schema = docs.select(*kept).schema
    for n in names:
        schema = schema.add(n, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.tile([1.0, 0.0], (batch.num_rows, 1))
            for p in parts(batch.column(at)) if shared.value else ():
                seen = look(p.data, p.offsets, insults, shared.value.learned)
                some = np.diff(seen.words.first) > 0
                out[p.first : p.last][some] = shared.value.scores(seen)[some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[:, 0]), pa.array(out[:, 1])], names=[*kept, *names])

    return docs.select(*kept).mapInArrow(tidy(run), schema)


def rejected(limit: float = 0.5) -> Column:
    return (F.col("low_score") >= limit) | (F.col("toxic_score") >= limit)
