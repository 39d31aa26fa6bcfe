"""URL verdicts from rules, and beyond them from a tree of path templates per host.

The tree is grown level by level over the distinct (host, path) pairs, to the deepest path. Below a node, a
segment with enough urls for a test stays literal, however small its share of the node; of these, branches whose labels and
continuations do not differ significantly are merged, each into the heaviest that it is like. Rarer segments become one
wildcard, except labelled ones whose labels differ significantly from the wildcard's. A template is rejected if the
smoothed share of blocked urls among its labelled ones is a half or more; urls under a rule are the labels.

One aggregation chain per level over distinct paths; merging sees a row per node and distinct numbers of a branch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestplane.llm.joins import beside
from nestplane.sources.shared import Workspace

LEAST = 5  # urls that a literal branch needs
BROADCAST_PATHS = 5_000  # facts of branches, templates or paths that may be broadcast ...
BROADCAST_BYTES = 1_000_000  # ... and the bytes of their strings, as paths may be long
TABLES = 16  # tables of finished paths that are kept before they are written as one
SMOOTH = 5.0  # labelled urls' worth of ...
PRIOR = 0.25  # ... the blocked share that a template without labels is given
Z = 1.96  # branches that differ by less, in standard errors, are alike
WILD = "*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """``(host, path)``; both empty if the url is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule, else nulls. Rules are ``(verdict, host/path)``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


COUNTS = ("n", "blocked", "labelled", "end", "number", "word")


def apart(a, n, b, m):
    """Whether shares ``a / n`` and ``b / m`` differ significantly; shares of nothing do not tell, so they differ (arrays or numbers)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        pool = (a + b) / (n + m)
        error = np.sqrt(pool * (1 - pool) * (1 / n + 1 / m))
        return np.where((n == 0) | (m == 0), n != m, np.abs(a / n - b / m) > Z * error + 1e-12)


def merged(branches: pa.Table) -> pa.Table:
    """``name`` of the different kinds of literal branches of one node: the heaviest branch before it that a kind is like, else itself."""
    c = {k: branches.column(k).to_numpy().astype(np.float64) for k in COUNTS}
    segs = branches.column("seg").to_pylist()
    left = np.array(sorted(range(len(segs)), key=lambda i: (c["n"][i], segs[i]), reverse=True))
    names: list[str] = [""] * len(segs)
    while len(left):
        top = left[0]
        unlike = apart(c["blocked"][left], c["labelled"][left], c["blocked"][top], c["labelled"][top])
        for k in ("end", "number", "word"):
            unlike = unlike | apart(c[k][left], c["n"][left], c[k][top], c["n"][top])
        unlike[0] = False
        for i in left[~unlike]:
            names[i] = segs[top]
        left = left[unlike]
    return branches.select(["host", "prefix", *COUNTS, "_rows"]).append_column("name", pa.array(names, pa.string()))


def known(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with written ``facts``, whose ``_rows`` says how many rows have their key.

    Joins are never left to Spark's choice: it broadcasts by the size of compressed files, which can be a hundred times as large in the driver's memory.
    """
    return beside(rows, facts, keys, spread, how, most=BROADCAST_PATHS, most_bytes=BROADCAST_BYTES, sizes="_rows")


def templates(paths: DataFrame, space: Workspace) -> DataFrame:
    """``(host, path, template)`` of ``(host, path, n, blocked, labelled)``; templates are slash-joined segments."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    now = space.write(paths.withColumns({"segments": F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments), "prefix": F.lit("")}), "level0")
    columns, done, d = now.columns, [], 0
    while True:
        ended = now.where(F.size("segments") <= d)
        if d == 0 or ended.head(1):
            done.append(space.write(ended, f"ended{d}"))
        d += 1
        here = now.where(F.size("segments") >= d)
        if not here.head(1):
            break
        after = F.when(F.size("segments") == d, "end").when(F.element_at("segments", d + 1).rlike("[0-9]"), "number").otherwise("word")
        here = here.withColumn("seg", F.element_at("segments", d))
        branch = here.groupBy("host", "prefix", "seg").agg(
            *[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")],
            *[F.sum(F.when(after == k, F.col("n")).otherwise(0)).alias(k) for k in ("end", "number", "word")],
        )
        branch = space.write(branch, f"branches{d}")
        # branches of one node with equal numbers have equal tests, so one of them stands for all
        kinds = branch.where(F.col("n") >= LEAST).groupBy("host", "prefix", *COUNTS).agg(F.max("seg").alias("seg"), F.count("*").alias("_rows"))
        types = branch.select("host", "prefix", *COUNTS).schema.add("_rows", T.LongType()).add("name", "string")
        names = space.write(kinds.groupBy("host", "prefix").applyInArrow(merged, types), f"names{d}")
        literal = known(branch.where(F.col("n") >= LEAST), names, ["host", "prefix", *COUNTS], ["seg"]).select("host", "prefix", "seg", "name", F.col("n").alias("_rows"))
        rare = branch.where(F.col("n") < LEAST)
        pool = rare.groupBy("host", "prefix").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m"), F.sum((F.col("labelled") > 0).cast("bigint")).alias("_rows"))
        pool = space.write(pool.where("m > 0"), f"pool{d}")
        share = (F.col("blocked") + F.col("b")) / (F.col("labelled") + F.col("m"))
        error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / F.col("m")))
        odd = known(rare.where("labelled > 0"), pool, ["host", "prefix"], ["seg"]).where(F.abs(F.col("blocked") / F.col("labelled") - F.col("b") / F.col("m")) > Z * error + 1e-12)
        named = space.write(literal.unionByName(odd.select("host", "prefix", "seg", F.col("seg").alias("name"), F.col("n").alias("_rows"))), f"named{d}")
        grown = known(here, named, ["host", "prefix", "seg"], ["path"], "left").withColumn("prefix", F.concat_ws("/", "prefix", F.coalesce("name", F.lit(WILD))))
        grown = space.write(grown.select(*columns), f"grown{d}")
        # below a node of fewer urls no branch can be literal: the rest of such paths is wild
        small = grown.groupBy("host", "prefix").agg(F.sum("n").alias("all")).where(F.col("all") < LEAST)
        small = space.write(small.select("host", "prefix", F.lit(True).alias("small"), F.col("all").alias("_rows")), f"small{d}")
        wild = F.concat("prefix", F.repeat(F.lit("/" + WILD), F.size("segments") - d))
        marked = known(grown, small, ["host", "prefix"], ["path"], "left").withColumns({"prefix": F.when(F.col("small"), wild).otherwise(F.col("prefix")), "segments": F.when(F.col("small"), F.slice("segments", 1, d)).otherwise(F.col("segments"))})
        before, now = now, space.write(marked.select(*columns), f"level{d}")
        for old in (before, branch, names, pool, grown, named, small):
            space.drop(old)
        if len(done) >= TABLES:
            whole = space.write(_together(done), f"done{d}")
            for old in done:
                space.drop(old)
            done = [whole]
    return _together(done).select("host", "path", "n", "blocked", "labelled", F.col("prefix").alias("template"))


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, template, purity, verdict`` (columns of these names, in any case, are replaced).

    ``template`` and ``purity`` (the smoothed blocked share) are null where a rule decides. Null or malformed
    urls have an empty host and path, and are judged as that template. ``rules`` is a short list on the driver.
    """
    space = Workspace(pages.sparkSession, "urls")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "template", "purity", "verdict")]
    host, path = parsed(F.col(url_col).cast("string"))
    read = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules)
    read = read.withColumns({"rule": rule, "verdict": verdict})
    distinct = read.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum((F.coalesce("verdict", F.lit("")) == "block").cast("bigint")).alias("blocked"), F.count("verdict").alias("labelled")
    )
    grown = space.write(templates(space.write(distinct, "paths"), space), "templates")
    each = grown.groupBy("host", "template").agg(((F.sum("blocked") + SMOOTH * PRIOR) / (F.sum("labelled") + SMOOTH)).alias("purity"), F.sum((F.col("labelled") == 0).cast("bigint")).alias("_rows"))
    each = space.write(each, "purities")
    decided = known(grown.where(F.col("labelled") == 0), each, ["host", "template"], ["path"]).select("host", "path", "template", "purity", F.col("n").alias("_rows"))
    decided = space.write(decided, "decided")
    open_ = known(read.where("rule is null").drop("verdict"), decided, ["host", "path"], kept)
    method = open_.withColumn("verdict", F.when(F.col("purity") >= 0.5, "block").otherwise("allow"))
    by_rule = read.where("rule is not null").withColumns({"template": F.lit(None).cast(T.StringType()), "purity": F.lit(None).cast("double")})
    columns = [*kept, "host", "path", "rule", "template", "purity", "verdict"]
    return by_rule.select(*columns).unionByName(method.select(*columns))
