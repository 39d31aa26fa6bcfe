"""One registered query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestplane.llm import audit, caps, codes, decontam, html, langid, packing, quality, quotes, simhash, tokens, toxicity, urls
from nestplane.llm.text import small_batches
from nestplane.sources.ship import ship


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf).rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    out = packing.packed_documents(table(spark, sf, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, model, columns=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    found = quotes.link(table(spark, sf, "conversations"))
    return found.withColumn("chat", quotes.rendered())


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scorer = quality.fit(docs, table(spark, sf, "labels"))
    return quality.scored(docs, scorer).select("doc_id", "low_score", "toxic_score", (~quality.rejected()).alias("kept"))


def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages").select("page_id", "url", "html"))


def op8_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf, "embeddings"))


def sample_edits(id_col: str = "doc_id", text_col: str = "text", edits: int = 3):
    """Edits made from a document itself: at places drawn by its id, a few characters give way to others of its own."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    draw = lambda k, n: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), n)

    def edit(k: int):
        taken = F.substring(F.coalesce(F.col(text_col), F.lit("")), (draw(3 * k + 1, size + 1) + 1).cast("int"), F.lit(24))
        return F.struct(draw(3 * k, size + 1).alias("pos"), draw(3 * k + 2, F.lit(40)).alias("del"), taken.alias("ins"))

    return F.array(*[edit(k) for k in range(edits)])


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("edits", sample_edits())
    found = tokens.edited_counts(docs, "edits")
    return found.drop("text_edited")


#: The rules of the contract (fixed values).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op10_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    found = urls.judge(table(spark, sf, "pages").select("page_id", "url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.scored(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_spans").alias("spans"),
    )


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.fingerprint(books)).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(audit.flags(table(spark, sf, "documents")), table(spark, sf, "labels"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


_ALL = [
    op1_best_fit_packing,
    op2_language_id,
    op3_decontamination,
    op4_simhash,
    op5_chat_formatting,
    op6_quality,
    op7_html_extraction,
    op8_embedding_near_dedup,
    op9_token_counts,
    op10_url_filters,
    op11_toxicity,
    op12_vector_codes,
    op13_filter_audit,
    pipeline,
]


def _shipping(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return query(spark, str(sf_dir).rstrip("/"))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {q.__name__: _shipping(q) for q in _ALL}

#: Queries that SQL can express at reasonable cost; tests/llm compares the others with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""
with dw as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), iw as (
    select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), wins as (
    select distinct item_id, least(13, len(w)) as size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') as win
    from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as k from iw where len(w) > 0)
), sizes as (
    select distinct size from wins
), places as (
    select doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') as win
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from dw, sizes where len(w) >= size)
), found as (
    select doc_id, p.size, k, item_id from places p join wins using (win, size)
), hits as (
    select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(k, k + size)) as spot from found) group by 1
), items as (
    select doc_id, list_sort(list(distinct item_id)) as ids from found group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hits using (doc_id) left join items using (doc_id)
""",
    "op12_vector_codes": """
with kept as materialized (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), ps as materialized (
    select vec_id, p, v[16 * p + 1 : 16 * p + 16] as x from kept, (select unnest(range(4)) as p)
), c0 as materialized (
    select p, rank() over (partition by p order by vec_id) - 1 as e, x as c from ps qualify e < 256
), """
    + "".join(
        f"""
a{k} as materialized (
    select vec_id, p, x, min({{'d': d, 'e': e}}) as best
    from (select vec_id, ps.p, x, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) as d from ps join c{k} using (p))
    group by all
), """
        + (
            f"""
m{k} as (
    select p, e, list(m order by i) as c
    from (select p, best.e as e, i, cast(floor(sum(x[i]) / count(*)) as bigint) as m from a{k}, (select unnest(range(1, 17)) as i) group by all) group by all
), c{k + 1} as materialized (
    select p, e, coalesce(m{k}.c, c{k}.c) as c from c{k} left join m{k} using (p, e)
), """
            if k < 4
            else """
book as (
    select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from c4
), coded as (
    select vec_id, string_agg(lower(printf('%02x', cast(best.e as int))), '' order by p) as code, cast(sum(best.d) as bigint) as error from a4 group by all
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (vec_id), book
"""
        )
        for k in range(5)
    ),
    "op13_filter_audit": r"""
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), f as (
    select doc_id, part,
        (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
        + (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) then 4 else 0 end)
        + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
        + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) as mask
    from d
), l as (
    select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1
), cells as materialized (
    select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from f left join l using (doc_id) group by all
), b as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as bit
), o as materialized (
    select b1.c || b2.c || b3.c || b4.c || b5.c as filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] as bits
    from b b1, b b2, b b3, b b4, b b5 where len(list_distinct([b1.c, b2.c, b3.c, b4.c, b5.c])) = 5
), s as materialized (
    select filter_order, k as step, bits[k] as bit, cast(coalesce(list_sum(bits[1 : k - 1]), 0) as int) as pre from o, (select unnest([1, 2, 3, 4, 5]) as k)
), r as (
    select part, filter_order, step, any_value(bit) as bit,
        sum(n) filter (mask & (pre | bit) = 0) as kept, sum(n) filter (mask & bit > 0 and mask & pre = 0) as removed,
        sum(n) filter (mask & bit > 0 and mask & pre > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
        sum(n) filter (good and mask & bit > 0 and mask & pre = 0) as good_lost, sum(n) filter (toxic and mask & bit > 0 and mask & pre = 0) as toxic_lost
    from cells, s group by part, filter_order, step
)
select part, filter_order, cast(step as int) as step,
    cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
    cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
    cast(sum(coalesce(removed, 0)) over (partition by part, bit) as bigint) as shapley
from r
""",
}
