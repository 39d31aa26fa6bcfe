"""Filter audit, vector codes and toxicity beside brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestplane.llm import audit, codes, queries, toxicity
from nestplane.sources.shared import Workspace

# --- filter audit -------------------------------------------------------------------------------


def brute_mask(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    mask = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
    return mask + 8 * bool(re.search("[#$%&*|]", t))


def brute_flags(rows):
    """``{(id, part, mask): n}`` of ``(id, text, lang)`` rows."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    return Counter((i, p or "", brute_mask(t) + 16 * (i is not None and i > least[t or ""])) for i, t, p in rows)


def texts(n=90):
    r = random.Random(4)
    long = " ".join(r.choice("alpha beta gamma delta EPSILON zeta".split()) for _ in range(260))
    head = "the very same beginning of many texts, longer than any first prefix, " * 3
    pool = ["", None, "a", "ab", "abc", "a b", "X#", "\x85odd blank", "ünïcode ÄÖ", long, long + "x", long[:-1], head, "word " * 30_000]
    pool += [head + str(k) for k in range(20)] + [" ".join(f"w{r.randrange(900)}" for _ in range(240)) for _ in range(4)]
    rows = [(r.randrange(60), r.choice(pool), r.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + [(None, "a", "en"), (None, "a", "en"), (7, "a", "en"), (7, "a", "en"), (7, "a", None), (5, None, "de")]


@pytest.mark.parametrize("part_bytes", [audit.PART_BYTES, 6000])
def test_flags_against_brute_force(spark, part_bytes):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"ID": F.lit(1), "mask": F.lit("x"), "part": F.lit(2.0)})
    got = audit.flags(docs.repartition(5), part_bytes=part_bytes).groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).collect()
    assert {(r.id, r.part, r["mask"]): r.n for r in got} == dict(brute_flags(rows))


def test_crowded_prefixes_grow(spark):
    """Many different texts with one long beginning, and many copies of one text."""
    begin = "x" * 700
    rows = [(k, begin + f"{k:04d}", "en") for k in range(300)] + [(1000 + k, begin + "0007", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    space = Workspace(spark, "test")
    prefixes = audit.prefixed(docs, space, 20_000).select(F.length("prefix").alias("n")).distinct().collect()
    assert max(r.n for r in prefixes) > 700
    got = audit.flags(docs, part_bytes=40_000).where(audit.fails("E")).agg(F.sum("n"), F.min("id")).first()
    assert tuple(got) == (300, 1000)


def test_trie_holds_every_text():
    r = random.Random(1)
    words = {bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(400)} | {b""}
    trie = audit.Trie()
    for k, w in enumerate(sorted(words, key=hash)):
        trie.insert(w).held = w
    assert [t for t, _ in trie.terminals()] == sorted(words)
    assert all(t == n.held for t, n in trie.terminals())


def test_audit_against_all_orders(spark):
    rows = texts(150)
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    table = spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(audit.flags(docs), table).collect()}
    good = {a for a, b, _ in labels if b == 1}
    toxic = {a for a, _, c in labels if c}
    every = [(i, p, m) for (i, p, m), n in brute_flags(rows).items() for _ in range(n)]
    parts = {p for _, p, _ in every}
    assert len(got) == len(parts) * 600
    for part in parts:
        own = [(i, m) for i, p, m in every if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                out = [(i, m) for i, m in left if m & bit]
                left = [(i, m) for i, m in left if not m & bit]
                r = got[part, "".join(order), k + 1]
                assert (r.kept, r.removed) == (len(left), len(out))
                assert r.redundant == sum(1 for _, m in own if m & bit) - len(out)
                assert r.unique_fails == sum(m == bit for _, m in own)
                assert (r.good_lost, r.toxic_lost) == (sum(i in good and i is not None for i, _ in out), sum(i in toxic and i is not None for i, _ in out))
                shapley[f] += len(out)
        for (p, order, step), r in got.items():
            if p == part:
                assert r.shapley == shapley[order[step - 1]]


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(audit.flags(docs), labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, lang string")
    rows = audit.audit(audit.flags(one), None).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120


# --- vector codes -------------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """``{id: (code, error)}`` and the codebooks, in Python integers."""
    kept = [(i, [int(np.floor(np.float64(c) * scale)) for c in x]) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted(kept)[:entries]
    books = [[cut(v, p) for _, v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v in kept:
                own.setdefault(best(cut(v, p), p), []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else b for e, b in enumerate(books[p])]
    out = {}
    for i, v in kept:
        e = [best(cut(v, p), p) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for k in e), sum(far(cut(v, p), books[p][k]) for p, k in enumerate(e))
    return out, hashlib.sha256(",".join(str(c) for b in books for v in b for c in v).encode()).hexdigest()


def test_codes_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = [list(map(float, np.float32(r.normal(size=8)))) for _ in range(60)]
    x += [x[3], x[4], None, [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7, [0.0] * 8]
    rows = [(100 - i, v) for i, v in enumerate(x)]
    labels = [None if i % 5 == 0 else i % 3 for i, _ in rows]
    table = spark.createDataFrame([(i, v, k, 1, "c") for (i, v), k in zip(rows, labels)], "vec_id bigint, embedding array<float>, label int, code int, Error string")
    want, sha = brute_codes(rows, entries=16)
    for df in (table.coalesce(1), table.repartition(7)):
        got, books = codes.compress(df, entries=16)
        got = got.collect()
        assert {g.id: (g.code, g.error) for g in got} == want and len(got) == len(want)
        assert codes.fingerprint(books) == sha
        sums = Counter()
        for g in got:
            sums[g.label] += g.error
        assert all(g.label_error == sums[g.label] for g in got)


def test_limbs_are_exact():
    r = np.random.default_rng(2)
    for width, top in ((16, 1000), (16, codes.most_component(16)), (300, codes.most_component(300)), (1, 2**28)):
        x = r.integers(-top, top + 1, size=(50, width))
        y = r.integers(-top, top + 1, size=(9, width))
        x[0], y[0], y[1] = -top, top, -top
        bits = codes.limb_bits(width)
        assert width * (1 << 2 * bits) <= 1 << 53
        exact = [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]
        assert codes.dots(codes.limbs(x, bits), codes.limbs(y, bits), bits).tolist() == exact
        entry, far = codes.nearest(x, y)
        for k in range(len(x)):
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[k], q)) for q in y]
            assert (entry[k], far[k]) == (d.index(min(d)), min(d))


def test_ties_go_to_the_lower_index():
    entry, far = codes.nearest(np.array([[0], [5]]), np.array([[1], [-1], [1]]))
    assert entry.tolist() == [0, 0] and far.tolist() == [1, 16]


def test_code_edge_cases(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    got, books = codes.compress(spark.createDataFrame([], schema))
    assert got.count() == 0 and codes.fingerprint(books) == hashlib.sha256(b"").hexdigest()
    rows = [(3, [1.0] * 8, 1), (3, [1.0] * 8, 1), (4, [1.0] * 4, 1), (5, [3e38] + [0.0] * 7, None), (None, [2.0] * 8, None), (9, [], None)]
    got, _ = codes.compress(spark.createDataFrame(rows, schema))
    by = sorted(((r.id, r.code, r.error, r.label_error) for r in got.collect()), key=str)
    assert by == sorted([(3, "00000000", 0, 0), (3, "00000000", 0, 0), (4, None, None, 0), (5, None, None, 0), (None, "01010101", 0, 0), (9, None, None, 0)], key=str) or all(
        c is None for i, c, _, _ in by if i in (4, 5, 9)
    )
    nobody, _ = codes.compress(spark.createDataFrame([(None, [1.0] * 8, 1)], schema))
    assert [(r.id, r.code) for r in nobody.collect()] == [(None, None)]


def test_label_sums_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    r = np.random.default_rng(1)
    rows = [(i, [float(c) for c in r.normal(size=4)], None if i % 4 == 0 else i % 3) for i in range(40)]
    got = codes.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), entries=4)[0].collect()
    sums = Counter()
    for g in got:
        sums[g.label] += g.error
    assert len(got) == 40 and all(g.label_error == sums[g.label] for g in got)


# --- toxicity -----------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(toxicity.WEIGHTS), -0.7, np.log([[0.8, 0.2], [0.3, 0.6]]))
    sizes = [1, 5, 3, 8, 2, 7] * 12
    odds, first = r.normal(size=sum(sizes)) * 2, np.zeros(sum(sizes), bool)
    at = np.cumsum([0] + sizes[:-1])
    first[at] = True
    marginal, pairs = toxicity.beliefs(odds, first, field, pairs=True)
    want, moves = [], np.zeros((2, 2))
    for a, n in zip(at, sizes):
        total, own, own_moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for z in itertools.product((0, 1), repeat=n):
            p = np.exp(field.start * z[0] + sum(odds[a + i] * z[i] for i in range(n)) + sum(field.moves[z[i - 1], z[i]] for i in range(1, n)))
            total += p
            own += p * np.array(z)
            for i in range(1, n):
                own_moves[z[i - 1], z[i]] += p
        want.append(own / total)
        moves += own_moves / total
    assert np.allclose(marginal, np.concatenate(want)) and np.allclose(pairs, moves)


def test_field_learns_from_open_words():
    """Toxic words that stay open are found by what they share with labelled ones."""
    kinds = np.zeros((toxicity.GROUPS, 4000), np.uint8)
    r = np.random.default_rng(3)
    bad = r.random(4000) < 0.1
    kinds[0] = np.where(bad, 7, 3)
    kinds[1] = toxicity.OWN[1] + np.where(bad, 6, 3)
    for k in range(2, toxicity.GROUPS):
        kinds[k] = {**{i: o + 3 for i, o in enumerate(toxicity.OWN)}, toxicity.GROUPS - 3: toxicity.BEFORE + 3, toxicity.GROUPS - 2: toxicity.AFTER + 3, toxicity.GROUPS - 1: toxicity.LONG}[k]
    first = np.arange(4000) % 40 == 0
    toxic = np.repeat(np.arange(100) % 2 == 0, 40)
    open_ = r.random(4000) < 0.5
    allowed = np.column_stack([~(toxic & bad & ~open_), toxic & (bad | open_)])
    kinds[:2, ~toxic] = [[3], [toxicity.OWN[1] + 3]]
    field = toxicity.fit_field(kinds, first, allowed)
    marginal, _ = toxicity.beliefs(toxicity.emission(kinds, field), first, field)
    assert (marginal[toxic & bad] > 0.5).mean() > 0.95 and (marginal[~toxic] > 0.5).mean() < 0.02


@pytest.fixture(scope="module")
def insults(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    bad = ["zork" + e for e in ("", "en", "ig", "st", "aft")] + ["wübel"]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(vocabulary) for _ in range(r.randrange(5, 120))]
        toxic = i % 6 == 0
        for _ in range(r.randrange(3, 6) if toxic else (r.random() < 0.02)):
            words.insert(r.randrange(len(words)), r.choice(bad).upper() if r.random() < 0.3 else r.choice(bad))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, table, toxicity.fit(docs, table.where(~toxicity.held_out()))


def test_held_out_toxicity_and_spans(spark, insults):
    docs, table, model = insults
    got = toxicity.scored(docs, model).join(table, "doc_id").withColumn("held_out", toxicity.held_out()).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 120 and {r.held_out for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    assert np.mean([(r.toxic_score >= 0.5) == (r.toxic == 1) for r in held]) > 0.97
    found = [(r.text[s.start : s.end], s.score) for r in held for s in r.toxic_spans if r.toxic]
    assert np.mean([bool(re.search("zork|wübel", t, re.IGNORECASE)) for t, _ in found]) > 0.95
    inside = sum(len(re.findall("zork|wübel", t, re.IGNORECASE)) for t, _ in found)
    assert inside > 0.9 * sum(len(re.findall("zork|wübel", r.text, re.IGNORECASE)) for r in held if r.toxic)
    assert all(0.5 <= s <= 1 and 0 <= r.toxic_score <= 1 for r in held for s in [1.0])


def test_held_out_labels_are_not_read(spark, insults):
    docs, table, model = insults
    turned = table.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned.where(~toxicity.held_out()))
    assert np.array_equal(again.evidence, model.evidence) and np.allclose(again.weights, model.weights)


def test_toxicity_edge_cases(spark, insults):
    _, _, model = insults
    rows = [(None, "zorken zorkig zork you", "a"), (1, None, None), (2, "", "b"), (3, " \n 12 ", "c"), (4, "lua " * 30_000 + "zork zorkst zorkig", "d"), (4, "lua", "d"), (4, "lua", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, TOXIC_SCORE string").withColumn("toxic_Spans", F.lit(1))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and sorted(got[0].asDict()) == ["doc_id", "text", "toxic_score", "toxic_spans"]
    none = [r for r in got if r.doc_id in (1, 2, 3)]
    assert len({r.toxic_score for r in none}) == 1 and all(r.toxic_spans == [] and r.toxic_score < 0.5 for r in none)
    assert next(r for r in got if r.doc_id is None).toxic_score > 0.5
    long = next(r for r in got if r.text and len(r.text) > 1000)
    assert any("zork" in long.text[s.start : s.end] for s in long.toxic_spans)
    assert toxicity.scored(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, None)], [(1, 1)], [(None, 1)]])
def test_labels_of_one_class(spark, labels):
    docs = spark.createDataFrame([(1, "some words"), (2, "other words"), (None, "x")], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = toxicity.scored(docs, model).collect()
    assert {r.toxic_score for r in got} == {1.0 if labels == [(1, 1)] else 0.0} and all(r.toxic_spans == [] for r in got)


def test_toxicity_query(spark, sf):
    rows = queries.QUERIES["op11_toxicity"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
