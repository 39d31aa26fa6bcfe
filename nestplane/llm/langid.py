"""Language identification by prediction by partial matching (PPM).

Per language, counts of every byte after its three, two, one and no preceding bytes are summed over all
training documents and frozen. A byte's code length walks from the longest context down: seen there, it
costs ``-log2(c / (T + D))``; otherwise the escape ``-log2(D / (T + D))`` is paid and the next shorter
context is asked (method C; T occurrences and D different successors), down to one of 256 bytes. The
language with the shortest code for the whole text wins.

All counts stay in a written table. Code lengths of the most frequent four-byte strings are broadcast (a
fixed number of them); a document lists its other strings with their counts, and these are priced by
joins with the tables of counts. So nothing is cut from the statistics, however large they grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestplane.llm.text import LOWER, parts, tidy
from nestplane.sources.shared import Workspace

ORDER = 3
#: Code lengths (a string's, in one language) that are broadcast; the others are found by joins.
HEAD = 1 << 22
#: Four-byte strings a training task holds before it passes them on.
HELD = 1 << 22
#: Parts over which the documents that hold one string are dealt when its code lengths are joined to them.
SALTS = 16
#: Documents decided by joins whose verdicts may be broadcast (about 50 bytes each).
BROADCAST_ROWS = 500_000
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of all ids that is kept for judging."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte (A-Z lower-cased), it and its three predecessors as one number; spaces stand before a text."""
    n, lengths = len(data), np.diff(offsets)
    put = np.arange(n) + np.repeat(ORDER * np.arange(1, len(lengths) + 1), lengths)
    wide = np.full(n + ORDER * len(lengths), 0x20, dtype=np.uint32)
    wide[put] = LOWER[data]
    code = wide.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= wide[:-k] << np.uint32(8 * k)
    return code[put], lengths


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", head: int = HEAD) -> Model | None:
    """Frozen statistics of all rows with a language and a text; null if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merge(lang: str):
            every = np.concatenate([g for g, _ in held[lang]])
            u, back = np.unique(every, return_inverse=True)
            held[lang] = [(u, np.bincount(back, np.concatenate([c for _, c in held[lang]])).astype(np.int64))]
            return len(u)

        def flush():
            for lang in list(held):
                merge(lang)
                u, c = held.pop(lang)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u.astype(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                for p in parts(batch.filter(pc.equal(langs, lang)).column(0)):
                    code = np.sort(grams(p.data, p.offsets)[0])
                    if not len(code):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    held.setdefault(lang, []).append((code[first], np.diff(np.append(first, len(code)))))
                    size += len(first)
            if size > HELD:
                size = sum(merge(lang) for lang in held)
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    space = Workspace(docs.sparkSession, "langid")
    counts = rows.mapInArrow(tidy(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = space.write(counts, "counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    return Model(langs, counts, space, head) if langs else None


def _suffix(k: int) -> Column:
    """The last ``k + 1`` bytes of a string."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


class Model:
    """Code lengths of bytes by context: tables of counts by depth, and those of the head as sorted arrays."""

    def __init__(self, langs: list[str], counts: DataFrame, space: Workspace, head: int):
        self.langs = langs
        by_depth = counts.select("lang", "n", F.posexplode(F.array(*[_suffix(k) for k in range(ORDER + 1)])).alias("k", "key"))
        self.seen = space.write(by_depth.groupBy("k", "lang", "key").agg(F.sum("n").alias("n")), "seen")
        followed = self.seen.groupBy("k", "lang", F.shiftright("key", 8).alias("context"))
        self.contexts = space.write(followed.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")), "contexts")
        self.keys, self.costs = self._head(counts, head // len(langs))

    def resolve(self, asked: DataFrame) -> DataFrame:
        """``(gram, lang, bits)``: code length of the last byte of every ``gram`` in ``asked``, ``lang`` by its number.

        Contexts and strings of up to two bytes are 65,536 a language at most, so they are broadcast.
        """
        out = asked.select("gram", F.posexplode(F.array(*[F.lit(x) for x in self.langs])).alias("number", "lang"))
        for k in range(ORDER, -1, -1):
            seen = self.seen.where(F.col("k") == k).select("lang", F.col("key").alias("key"), F.col("n").alias(f"n{k}"))
            context = self.contexts.where(F.col("k") == k).select("lang", "context", F.col("total").alias(f"t{k}"), F.col("distinct").alias(f"d{k}"))
            seen, context = (F.broadcast(seen) if k < 2 else seen), (F.broadcast(context) if k < 3 else context)
            out = out.withColumn("key", _suffix(k)).join(seen, ["lang", "key"], "left")
            out = out.withColumn("context", F.shiftright("key", 8)).join(context, ["lang", "context"], "left").drop("key", "context")
        bits = F.lit(8.0)
        for k in range(ORDER + 1):
            n, total, distinct = F.col(f"n{k}"), F.col(f"t{k}"), F.col(f"d{k}")
            found, escaped = -F.log2(n / (total + distinct)), -F.log2(distinct / (total + distinct))
            bits = F.when(n.isNotNull(), found).when(total.isNotNull(), escaped + bits).otherwise(bits)
        return out.select("gram", F.col("number").alias("lang"), bits.cast("float").alias("bits"))

    def _head(self, counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``most`` strings, by powers of two of their counts, and their code lengths, a column a language."""
        grams = counts.groupBy("gram").agg(F.floor(F.log2(F.sum("n"))).alias("power"))
        sizes = {r["power"]: r["count"] for r in grams.groupBy("power").count().collect()}  # 64 rows at most
        least, held = 64, 0
        for power in sorted(sizes, reverse=True):
            held += sizes[power]
            if held > most:
                break
            least = power
        table = self.resolve(grams.where(F.col("power") >= least).select("gram")).toArrow()
        gram, lang = table["gram"].to_numpy(), table["lang"].to_numpy()
        order = np.lexsort((lang, gram))
        return gram[order][:: len(self.langs)], table["bits"].to_numpy()[order].reshape(-1, len(self.langs))


def _choice(totals: Column) -> tuple[Column, Column, Column]:
    """Number of the first language with the least total, its share by two to the minus code length, and that total."""
    least = F.array_min(totals)
    share = 1 / F.aggregate(totals, F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), F.greatest(least - x, F.lit(-1000.0))))
    return F.array_position(totals, least).cast("int"), share, least


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", columns: list[str] | None = None, with_rate: bool = False) -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) with ``lang_pred`` and ``score`` (columns of these names, in any case, are replaced).

    ``with_rate`` adds ``rate``, the winner's code length in bits a byte, and ``size``, the text's bytes; both null for ``und``. The score is the winner's share when languages are weighed by two to the minus code length; 0 for ``und``:
    a null text, one without any letter, or no model. Equal code lengths go to the first language by name.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in ("lang_pred", "score", *("rate", "size") * with_rate)]
    if model is None:
        none = [F.lit(None).cast("double").alias("rate"), F.lit(None).cast("bigint").alias("size")] * with_rate
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *none[:2])
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.costs))  # HEAD numbers, whatever the corpus
    langs = model.langs
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], F.col(text_col).alias("text"))
    if text_col in kept:
        rows, at = rows.drop("text"), kept.index(text_col)
    else:
        at = len(kept)
    pairs = T.ArrayType(T.StructType().add("gram", T.LongType()).add("n", T.LongType()))
    schema = rows.select(*names).schema.add("letters", T.BooleanType()).add("size", T.LongType()).add("bits", T.ArrayType(T.DoubleType())).add("rest", pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, costs = shared.value
        for batch in batches:
            texts, n = batch.column(at), batch.num_rows
            bits, others, size = np.zeros((n, len(langs))), [(np.zeros(0, np.int64),) * 3], np.zeros(n, np.int64)
            for p in parts(texts):
                size[p.first : p.last] = np.diff(p.offsets)
                code, lengths = grams(p.data, p.offsets)
                if not len(code):
                    continue
                asked = np.sort(code)
                asked = asked[np.concatenate([[True], asked[1:] != asked[:-1]])]
                where = np.searchsorted(asked, code)
                asked = asked.astype(np.int64)
                spot = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
                known = keys[spot] == asked if len(keys) else np.zeros(len(asked), bool)
                some = np.flatnonzero(lengths)
                for j in range(len(langs)):
                    cost = np.zeros(len(asked))
                    cost[known] = costs[spot[known], j]
                    bits[p.first + some, j] = np.add.reduceat(cost[where], p.offsets[:-1][some])
                left = ~known[where]
                if left.any():
                    pair = np.repeat(np.arange(len(lengths)), lengths)[left] * len(asked) + where[left]
                    pair, times = np.unique(pair, return_counts=True)
                    others.append((p.first + pair // len(asked), asked[pair % len(asked)], times))
            doc, gram, times = (np.concatenate(x) for x in zip(*others, strict=True))
            begins = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
            rest = pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays([pa.array(gram), pa.array(times.astype(np.int64))], names=["gram", "n"]))
            wide = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(langs)), pa.array(bits.ravel()))
            letters = pc.fill_null(pc.match_substring_regex(texts, HAS_LETTER), False)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], letters, pa.array(size), wide, rest], names=[*names, "letters", "size", "bits", "rest"])

    space = Workspace(docs.sparkSession, "langid")
    scored = space.write(rows.mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    more = scored.where(F.col("letters") & (F.size("rest") > 0)).select("row", F.inline("rest"))
    priced = model.resolve(more.select("gram").distinct()).groupBy("gram").agg(*[F.max(F.when(F.col("lang") == j, F.col("bits"))).alias(f"b{j}") for j in range(len(langs))])
    priced = priced.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    more = more.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(priced, ["gram", "salt"])
    more = more.groupBy("row").agg(*[F.sum(F.col("n") * F.col(f"b{j}").cast("double")).alias(f"b{j}") for j in range(len(langs))])
    number, share, least = _choice(F.array(*[F.col("bits")[j] + F.col(f"b{j}") for j in range(len(langs))]))
    decided = scored.select("row", "bits").join(more, "row").select("row", number.alias("number"), share.alias("share"), least.alias("least"))
    decided = space.write(decided, "decided")
    if decided.count() <= BROADCAST_ROWS:  # else the kept columns are shuffled, evenly
        decided = F.broadcast(decided)
    number, share, least = _choice(F.col("bits"))
    lang_pred = F.element_at(F.array(*[F.lit(x) for x in langs]), F.coalesce("number", number))
    return scored.join(decided, "row", "left").select(
        *[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)],
        F.when(F.col("letters"), lang_pred).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.coalesce("share", share)).otherwise(0.0).alias("score"),
        *[F.when(F.col("letters"), F.coalesce("least", least) / F.col("size")).alias("rate"), F.when(F.col("letters"), F.col("size")).alias("size")][: 2 * with_rate],
    )


#: Texts of at least so many bytes tell what a language's code lengths are like.
TYPICAL_BYTES = 200
#: A text is foreign if its rate is so many spreads above its language's median; a byte's own code length varies by about ``BYTE_SPREAD`` bits. The least
#: spread leaves room for texts that mix learned languages, which cost up to twice the usual rate; unlearned languages and codes cost far more.
SPREADS, BYTE_SPREAD, LEAST_SPREAD = 6.0, 3.0, 0.75


def rates(judged: DataFrame) -> DataFrame:
    """``(of, middle, spread)``: median rate of each predicted language over all longer texts, and how far the sixth part above lies from it.

    Both are quantiles, so a few foreign texts among them do not move them. A row a language.
    """
    typical = judged.where(F.col("size") >= TYPICAL_BYTES).groupBy(F.col("lang_pred").alias("of"))
    quantiles = typical.agg(F.percentile_approx("rate", [0.5, 0.84], 1000).alias("q"))
    return quantiles.select("of", F.col("q")[0].alias("middle"), F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD)).alias("spread"))


def with_foreign(judged: DataFrame) -> DataFrame:
    """``judged`` (of ``predict``, with rates) with ``foreign``: whether no learned language explains the text.

    True for ``und``, for a winner not likelier than all others together, and for a text that costs far more bits a byte than
    its language's texts do; a short text may cost more. A language without longer texts rejects none by cost.
    """
    both = judged.join(F.broadcast(rates(judged)), F.col("lang_pred") == F.col("of"), "left")
    spread = F.sqrt(F.pow("spread", F.lit(2)) + BYTE_SPREAD**2 / F.col("size"))
    costly = F.coalesce(F.col("rate") > F.col("middle") + SPREADS * spread, F.lit(False))
    return both.withColumn("foreign", rejected() | costly).drop("of", "middle", "spread")


def rejected(lang_pred="lang_pred", score="score", least: float = 0.5) -> Column:
    """No language, or none that is likelier than all others together."""
    return (F.col(lang_pred) == UNKNOWN) | (F.col(score) < least)
