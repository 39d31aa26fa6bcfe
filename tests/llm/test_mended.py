"""Column names that clash in any case, hot keys, foreign texts, page sections, and the pipeline's stages beside brute force."""

import base64
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nestplane.llm import decontam, html, joins, langid, packing, quality, simhash, text, toxicity, urls
from nestplane.llm.components import components
from nestplane.sources.shared import Workspace

def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        assert sum(n for _, n in places) <= capacity
        assert sorted(o for o, _ in places) == [sum(n for o2, n in places if o2 < o) for o in sorted(o for o, _ in places)]
    return len(by)


WORDS = "Long enough words of an article, told plainly. " * 6


# --- pages --------------------------------------------------------------------------------------


@pytest.mark.parametrize("tag", ["div", "section"])
def test_sections_without_an_article_stay(tag):
    names = ("introduction", "methods", "related-work", "results", "discussion", "search-results")
    page = "<body>" + "".join(f"<{tag} id={i}><h2>{i}</h2>{f'<p>{WORDS}</p>' * 4}</{tag}>" for i in names) + "</body>"
    assert html.main_text(page).split("\n") == [x for i in names for x in (i, *[WORDS.strip()] * 4)]


def test_suspects_go_by_density():
    body = f"<div id=text>{f'<p>{WORDS}</p>' * 4}</div>"
    thin = "<div class='related'>" + "<p>A short line</p>" * 12 + "</div>"
    links = "<div class='social'>" + "<p><a href=x>Follow this and that other thing now</a></p>" * 9 + "</div>"
    replies = f"<div class='comments'><p>{WORDS}</p></div>"
    assert html.main_text(f"<body>{body}{thin}{links}{replies}</body>").split("\n") == [WORDS.strip()] * 4
    assert html.main_text(f"<body><div class='related'><p>{WORDS}</p></div></body>") == WORDS.strip()


@pytest.mark.parametrize("page", ['<a title="x ' * 90_000, "<a" * 500_000, "<div>" * 8000 + "</b>" * 8000 + "x", "<!-- " * 200_000, "<a b " * 200_000, "<div><p>" * 20_000])
def test_broken_pages_take_linear_time(page):
    start = time.time()
    html.main_text(page)
    assert time.time() - start < 5


def test_open_quotes_and_ends():
    assert html.main_text("<p title='a>b'>one</p><p title=\"x>two</p>") == "one\ntwo"
    assert html.main_text("<p>one</p><p titl") == "one"
    assert html.main_text("a < b and <3 and c > d") == "a < b and <3 and c > d"


# --- quality ------------------------------------------------------------------------------------


def test_a_text_is_hashed_once_for_its_votes_and_score(monkeypatch):
    """Votes, learned words and hashed features share one set of prefix sums and one hash of each word."""
    sizes = []
    for module in (quality, toxicity):
        monkeypatch.setattr(module, "prefix_sums", lambda values: (sizes.append(len(values)), text.prefix_sums(values))[1])
    (part,) = text.parts(pa.array(["You IDIOT, you fool!! STOP! 12 # ...", None, "plain words of a text, of a text " * 40]))
    seen = quality.look(part.data, part.offsets, quality.INSULTS, np.ones(1 << toxicity.BITS, dtype=bool))
    doc, feature = quality.features(seen)
    assert sizes.count(len(part.data)) == 1
    assert np.array_equal(quality.distinct_hashes(seen.hashed, seen.words), [7, 0, 6])
    assert len(set(zip(doc, feature, strict=True))) == len(doc) and set(doc) == {0, 2}
    assert [seen.style[k][0] for k in ("lone_marks", "shouts", "insults")] == [3 / 8, 1 / 8, 2 / 5]


@pytest.mark.parametrize("shift", [0, 5000])  # keys of 32 and of 64 bits
def test_distinct_pairs_beside_sets(shift):
    rng = np.random.default_rng(5)
    doc, feature = np.sort(rng.integers(0, 40, 900)) + shift, rng.integers(0, 1 << 20, (3, 900)) % 50 * 20_000
    got = text.distinct_pairs(doc, feature, 20)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == sorted({(int(d), int(f)) for row in feature for d, f in zip(doc, row, strict=True)})
    assert [len(x) for x in text.distinct_pairs(doc[:0], feature[:, :0], 20)] == [0, 0]


def test_word_counts_by_half_and_class(spark):
    rows = [(0, 0, "One two, one TWO"), (0, 1, "two"), (1, 1, "two two three"), (1, 1, None), (1, 0, "")]
    found = {r.feature: r.c for r in toxicity.word_counts(spark.createDataFrame(rows, "half int, toxic int, text string")).collect()}
    (part,) = text.parts(pa.array(["one two three"]))
    one, two, three = toxicity.read(part.data, part.offsets).hashed[0].tolist()
    assert (found[-1], found[one], found[two], found[three]) == ([1, 1, 1, 2], [1, 0, 0, 0], [1, 1, 0, 1], [0, 0, 0, 1])


# --- column names -------------------------------------------------------------------------------


def test_names_clash_in_any_case(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>t</p>", "o", "h", "u", 1)], "page_id bigint, url string, html string, Text string, Host string, url_ string, RULE int")
    assert html.extract(pages).first().text == "t"
    judged = urls.judge(pages, [("block", "net/")]).first()
    assert (judged.host, judged.rule, judged.url_) == ("a.net", "net/", "u")
    docs = spark.createDataFrame([(1, "some words", "x", 5, 2, "en", "y", 3)], "doc_id bigint, text string, N_Words string, Low_Score int, _ROW int, lang string, Lang_Pred string, Row int")
    assert decontam.decontaminate(docs, spark.createDataFrame([("i", "some words")], "item_id string, text string")).first().n_hit == 2
    assert quality.scored(docs, None).first().low_score == 1.0
    assert langid.predict(docs, None).first().lang_pred == "und"
    placed = spark.createDataFrame([(1, 5, "a"), (2, 2048, "b")], "doc_id bigint, length bigint, Row string").withColumn("OFFSET", F.lit("x"))
    rows = {r.doc_id: r for r in packing.packed(placed).collect()}
    assert {k: r.Row for k, r in rows.items()} == {1: "a", 2: "b"} and all(r["offset"] == 0 for r in rows.values())


# --- hubs ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_hubs_and_chains(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST_FACTS", most)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 1000), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, Workspace(spark, "hubs")).collect()}
    assert got == {**{k: 0 for k in range(400)}, **{k: 0 for k in range(1000, 1041)}}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_facts_beside_rows(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST_FACTS", most)
    rows = spark.createDataFrame([("hot", k) for k in range(90)] + [("b", 1), ("c", 2), (None, 3)], "k string, v bigint")
    facts = spark.createDataFrame([("hot", 10), ("b", 20)], "k string, w bigint")
    got = joins.beside(rows, facts, ["k"], ["v"], "left").groupBy("k").agg(F.count("*").alias("n"), F.max("w").alias("w")).collect()
    assert {(r.k, r.n, r.w) for r in got} == {("hot", 90, 10), ("b", 1, 20), ("c", 1, None), (None, 1, None)}
    assert joins.beside(rows, facts, ["k"], ["v"]).count() == 91


# --- packing ------------------------------------------------------------------------------------


def test_search_sees_past_many_equal_pieces():
    """Hundreds of pieces of one length hide none of the shorter ones."""
    bins = [[0, 1]] + [[2 + k] for k in range(300)] + [[302], [303]]
    lengths = [60, 30, *[50] * 300, 10, 10]
    out = packing.local_search(bins, lengths, 100)
    assert sorted(i for b in out for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in out) and len(out) <= 152


# --- language stage -----------------------------------------------------------------------------


def foreign_texts():
    r = random.Random(2)
    russian = "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. Съешь же ещё этих мягких булок да выпей чаю. "
    out = [russian * k for k in (2, 3, 8)]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (300, 900, 3000)]
    out += [base64.b64encode(r.randbytes(n)).decode() for n in (300, 900, 3000)]
    return out


def test_foreign_texts_are_rejected_and_others_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    planted = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(foreign_texts())], docs.schema)
    short = spark.createDataFrame([(-100 - k, t, None) for k, t in enumerate(["the thing", "of the", "le de que", "und die"])], docs.schema)
    judged = Workspace(spark, "judged").write(langid.predict(docs.unionByName(planted).unionByName(short), model, columns=["doc_id"], with_rate=True), "judged")
    gone = {r.doc_id for r in langid.with_foreign(judged).where("foreign").select("doc_id").collect()}
    assert {-1 - k for k in range(9)} <= gone
    assert not gone & {-100, -101, -102, -103}
    assert len([i for i in gone if i >= 0]) <= 0.002 * docs.count()


# --- the pipeline's stages beside brute force ---------------------------------------------------

STAGE_DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_near_dedup_stage(spark, sf):
    import corpus_pipeline as P

    r = random.Random(5)
    base = [" ".join(r.choice("one two three four five six seven eight nine ten".split()) for _ in range(60)) for _ in range(6)]
    rows = [(k, base[k % 6] if k % 4 else base[k % 6].replace("one", "uno", 1), "en", "s", k) for k in range(20)]
    nulls = [(None, base[0], "en", "s", 1), (None, base[0], "en", "s", 2), (3, base[1], "en", "s", 99)]
    for extra in ([], nulls):
        docs = spark.createDataFrame(rows + extra, STAGE_DOCS)
        got = Counter((d.doc_id, d.n_chars) for d in P.near_dedup(spark, docs, sf).collect())
        own = [(d[0], simhash.fingerprint(d[1].encode()), d[4]) for d in rows + extra]
        want = Counter((i, c) for i, _, c in own if i is None)
        left = [x for x in own if x[0] is not None]
        while left:
            group, more = [left.pop(0)], True
            while more:
                more = [x for x in left if any(bin(x[1] ^ g[1]).count("1") <= 2 for g in group)]
                group, left = group + more, [x for x in left if x not in more]
            least = min(g[0] for g in group)
            same = [g for g in group if g[0] == least]
            assert sum((i, c) in got for i, _, c in same) == 1
            want[next((i, c) for i, _, c in same if (i, c) in got)] += 1
        assert got == want


def test_decontamination_stage(spark, sf):
    import corpus_pipeline as P

    items = [lower(t.text) for t in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {d.doc_id for d in P.decontamination(spark, docs, sf).collect()}
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {tuple(w[k : k + 13]) for w in map(cut, items) for k in range(max(1, len(w) - 12)) if w}
    sizes = {len(w) for w in windows}
    for d in docs.collect():
        w = cut(d.text)
        hit = set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        assert (d.doc_id not in kept) == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_quality_and_packing_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scorer = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in quality.scored(docs, scorer).collect() if r.low_score < 0.5 and r.toxic_score < 0.5}
    assert {r.doc_id for r in P.quality_classifier(spark, docs, sf).collect()} == want
    rows = P.best_fit_packing(spark, docs, sf).collect()
    assert check_packed(rows, 2048) <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_language_stage(spark, sf):
    """Rates, quantiles and the verdict once more, from the predictions of all rows; repeated and null ids are judged one by one."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, t, None, "s", k) for k, t in enumerate(foreign_texts())] + [(1, "12 34", None, "s", 7), (1, None, None, "s", 8)], docs.schema)
    whole = Workspace(spark, "stage").write(docs.unionByName(odd), "docs")
    kept = Counter((r.doc_id, r.n_chars) for r in P.language_id(spark, whole, sf).collect())
    judged = langid.predict(whole, langid.train(whole), columns=["doc_id", "n_chars"], with_rate=True).collect()
    want = Counter()
    for r in judged:
        if r.lang_pred == "und" or r.score < 0.5:
            continue
        typical = sorted(x.rate for x in judged if x.lang_pred == r.lang_pred and x.size >= langid.TYPICAL_BYTES)
        q = [typical[max(0, -(-len(typical) * p // 100) - 1)] for p in (50, 84)] if typical else [9e9, 9e9]
        spread = (max(q[1] - q[0], langid.LEAST_SPREAD) ** 2 + langid.BYTE_SPREAD**2 / r["size"]) ** 0.5
        want[(r.doc_id, r.n_chars)] += r.rate <= q[0] + langid.SPREADS * spread
    assert kept == +want


def test_url_facts_beyond_a_broadcast(spark, monkeypatch):
    rules = [("block", "s.net/a/1"), ("allow", "t.net/")]
    rows = [(f"http://s.net/a/{k}", 1) for k in range(10, 24)] + [("http://s.net/a/9", k) for k in range(20)] + [(None, 1), (None, 2), ("http://t.net/x", 1)]
    pages = spark.createDataFrame(rows, "url string, page_id bigint")
    key = lambda df: Counter(tuple(r) for r in df.collect())
    want = key(urls.judge(pages, rules))
    monkeypatch.setattr(urls, "BROADCAST_PATHS", 0)
    assert key(urls.judge(pages, rules)) == want and sum(want.values()) == len(rows)


def test_copies_of_facts_are_never_broadcast(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 7).alias("k"), "id")
    facts = spark.createDataFrame([(k, f"fact {k}", 60) for k in range(5)], "k bigint, fact string, size bigint")
    want = Counter((k % 7, k, f"fact {k % 7}" if k % 7 < 5 else None) for k in range(400))
    monkeypatch.setattr(joins, "CROWD", 9)
    for more in ({"most": 0}, {"most": 0, "sizes": "size"}, {"most_bytes": 20, "sizes": "size"}, {"most_bytes": 200, "sizes": "size"}):
        got = joins.beside(rows, facts if "sizes" in more else facts.drop("size"), ["k"], ["id"], "left", **more)
        assert got.columns == ["k", "id", "fact"] and Counter(tuple(r) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (more.get("most_bytes") != 200)


def test_url_tables_are_never_broadcast_for_their_files(spark, monkeypatch):
    """What is small as a compressed file need not be in the driver's memory; long paths are not broadcast however few."""
    rules = [("block", "s.net/a/1"), ("allow", "t.net/")]
    rows = [(f"http://s.net/a/{k}", 1) for k in range(10, 24)] + [("http://s.net/a/9", k) for k in range(20)] + [(f"http://s.net/{'x' * 999}", 1), (None, 1), (None, 2), ("http://t.net/x", 1)]
    pages = spark.createDataFrame(rows, "url string, page_id bigint")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    key = lambda df: Counter(tuple(r) for r in df.collect())
    want = key(urls.judge(pages, rules))
    plans, write = {}, Workspace.write

    def kept(self, df, name, by=None):
        plans[name] = plan(df)
        return write(self, df, name, by)

    monkeypatch.setattr(Workspace, "write", kept)
    monkeypatch.setattr(joins, "CROWD", 4)
    for name, least, most in (("BROADCAST_BYTES", 900, 10**6), ("BROADCAST_PATHS", 0, 5000)):
        monkeypatch.setattr(urls, name, least)
        found = urls.judge(pages, rules)
        assert "SortMergeJoin" in plan(found) and key(found) == want and sum(want.values()) == len(rows)
        monkeypatch.setattr(urls, name, most)
    assert all("SortMergeJoin" in plans[k] for k in ("named1", "grown1", "decided"))  # of no facts an empty table is broadcast
