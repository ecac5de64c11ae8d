"""Aggregation pipeline, full-text search, vectors, fusion and the semantic cache over the driver's tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import sign_bits, hamming, sq8
from ..functions.text import STOP_WORDS
from ..operators import search, vectors
from ..operators.aggregate import Pipeline
from ..sources.tables import shared_dir, table
from .registry import query

# ------------------------------------------------------------------------------- aggregation


@query("agg_groupby_reduce_all", """SELECT l_returnflag, l_linestatus, count(*) AS cnt, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
  FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('A', 'R') GROUP BY ALL""")
def agg_groupby_reduce_all(s: SparkSession, d: str) -> DataFrame:
    p = Pipeline(table(s, d, "lineitem")).where("l_quantity BETWEEN 5 AND 45").where("l_returnflag IN ('A', 'R')")
    p = p.group_by(["l_returnflag", "l_linestatus"], ("count", None, "cnt"), ("sum", "l_extendedprice", "sum_price"), ("avg", "l_extendedprice", "avg_price"), ("min", "l_extendedprice", "min_price"), ("max", "l_extendedprice", "max_price"))
    return p.apply("round(sum_price, 2)", "sum_price").apply("round(avg_price, 4)", "avg_price").rows


@query("agg_groupby_global", "SELECT count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders")
def _(s, d):
    return Pipeline(table(s, d, "orders")).group_by([], ("count", None, "cnt"), ("sum", "o_totalprice", "total")).apply("round(total, 2)", "total").rows


@query("agg_apply_arith", "SELECT l_shipmode_key, round(taxed, 4) AS taxed FROM (SELECT l_linenumber AS l_shipmode_key, sum(l_extendedprice) * 1.1 / nullif(count(*), 0) AS taxed FROM lineitem GROUP BY 1)")
def _(s, d):
    p = Pipeline(table(s, d, "lineitem").withColumnRenamed("l_linenumber", "l_shipmode_key")).group_by(["l_shipmode_key"], ("sum", "l_extendedprice", "total"), ("count", None, "cnt"))
    return p.apply("round(coalesce(try_divide(total * 1.1, cnt), 0), 4)", "taxed").load("l_shipmode_key", "taxed").rows


@query("agg_filter_stage", "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY 1 HAVING count(*) > 12")
def _(s, d):
    return Pipeline(table(s, d, "orders")).group_by(["o_custkey"], ("count", None, "cnt")).where("cnt > 12").rows


@query("agg_sortby_limit", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    p = Pipeline(table(s, d, "orders")).group_by(["o_custkey"], ("sum", "o_totalprice", "total")).apply("round(total, 2)", "total")
    return p.sort_by(("total", True), ("o_custkey", False), limit=10).rows


@query("agg_load_projection", "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20")
def _(s, d):
    return Pipeline(table(s, d, "part")).where("p_size BETWEEN 10 AND 20").load("p_partkey", "p_brand", "p_retailprice").rows


@query("agg_multi_stage", "SELECT n_orders, count(*) AS n_customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) GROUP BY 1 ORDER BY 1 LIMIT 20")
def _(s, d):
    p = Pipeline(table(s, d, "orders")).group_by(["o_custkey"], ("count", None, "n_orders")).group_by(["n_orders"], ("count", None, "n_customers"))
    return p.sort_by(("n_orders", False), limit=20).rows


@query("agg_non_numeric", "SELECT event_type, coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 0) AS total FROM events GROUP BY 1")
def _(s, d):
    rows = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return Pipeline(rows).group_by(["event_type"], ("sum", "k", "total")).rows


# ------------------------------------------------------------------------------------ search

_words = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
#: The analyzer in SQL, for texts of letters that the library's lower() folds alike.
ANALYZED = f"""words AS (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
kept AS (SELECT doc_id, w, octet_length(encode(w)) AS n FROM words WHERE w <> '' AND w NOT IN ({_words})),
terms AS (SELECT doc_id, CASE WHEN suffix(w, 'ing') AND n > 5 THEN left(w, length(w) - 3) WHEN suffix(w, 'ies') AND n > 4 THEN left(w, length(w) - 3) || 'y'
  WHEN suffix(w, 'es') AND n > 4 THEN left(w, length(w) - 2) WHEN suffix(w, 'ed') AND n > 3 THEN left(w, length(w) - 2) WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND n > 3 THEN left(w, length(w) - 1) ELSE w END AS term FROM kept),
lengths AS (SELECT d.doc_id, count(t.doc_id) AS doc_len FROM (SELECT doc_id FROM documents) d LEFT JOIN terms t USING (doc_id) GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, greatest(1.0::DOUBLE, avg(doc_len)) AS mean_len FROM lengths),
postings AS (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
scored AS (SELECT p.term, p.doc_id, greatest(0.0001::DOUBLE, ln(1.0::DOUBLE + (n_docs - df + 0.5) / (df + 0.5))) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / mean_len))) AS part
  FROM postings p JOIN dfs USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats)"""


def index(s: SparkSession, d: str) -> search.Index:
    """The stored index of documents: created by the first query that asks for it, and anew if the table has changed since."""
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path)
    name = f"documents-{zlib.crc32(d.encode()):08x}-{status.getModificationTime()}-{s.sparkContext.applicationId}"
    catalog = search.Catalog(s, f"{shared_dir(s)}/keyframe/indexes")
    return catalog.open(name) if name in catalog.names() else catalog.create(name, table(s, d, "documents"), "doc_id", "text")


def rounded(hits: DataFrame, digits: int = 6) -> DataFrame:
    return hits.select("doc_id", F.round("score", digits).alias("score"))


@query("ft_term_bm25", f"WITH {ANALYZED} SELECT doc_id, round(sum(part), 6) AS score FROM scored WHERE term = 'stupid' GROUP BY 1")
def _(s, d):
    return rounded(index(s, d).term("stupid"))


@query("ft_multi_term_bm25", f"WITH {ANALYZED} SELECT doc_id, round(sum(part), 6) AS score FROM scored WHERE term IN ('license', 'version') GROUP BY 1 HAVING count(DISTINCT term) = 2")
def _(s, d):
    i = index(s, d)
    return rounded(search.all_of(i.term("license"), i.term("version")))


@query("ft_or", f"WITH {ANALYZED} SELECT doc_id, round(sum(part), 6) AS score FROM scored WHERE term IN ('stupid', 'moron') GROUP BY 1")
def _(s, d):
    i = index(s, d)
    return rounded(search.any_of(i.term("stupid"), i.term("moron")))


@query("ft_prefix", f"WITH {ANALYZED} SELECT doc_id, round(sum(part), 6) AS score FROM scored WHERE starts_with(term, 'licen') GROUP BY 1")
def _(s, d):
    return rounded(index(s, d).prefix("licen"))


@query("ft_and_or_not", f"WITH {ANALYZED}, hit AS (SELECT DISTINCT doc_id FROM scored WHERE term IN ('stupid', 'moron')), neg AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM scored WHERE term = 'trash')) SELECT doc_id FROM hit JOIN neg USING (doc_id) JOIN documents USING (doc_id) WHERE lang = 'en'")
def _(s, d):
    i = index(s, d)
    hits = search.all_of(search.any_of(i.term("stupid"), i.term("moron")), i.negate(i.term("trash")), search.filtered(table(s, d, "documents"), "doc_id", F.col("lang") == "en"))
    return hits.select("doc_id")


@query("ft_numeric_range", "SELECT p_partkey AS doc_id, 1.0::DOUBLE AS score FROM part WHERE p_retailprice BETWEEN 920 AND 940")
def _(s, d):
    return search.filtered(table(s, d, "part"), "p_partkey", F.col("p_retailprice").between(920, 940))


@query("ft_tag_filter", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lower(source) IN ('src1', 'src2')")
def _(s, d):
    return search.filtered(table(s, d, "documents"), "doc_id", search.tag("source", ["SRC1", "src2"]))


@query("ft_sortby_paging", "SELECT p_partkey AS doc_id, p_name FROM part WHERE p_size = 15 ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
def _(s, d):
    hits = table(s, d, "part").where("p_size = 15").withColumnRenamed("p_partkey", "doc_id")
    return search.page(hits, 10, 5, "p_retailprice", descending=True).select("doc_id", "p_name")


@query("ft_return_fields", "SELECT doc_id, lang, source FROM documents WHERE n_chars BETWEEN 1000 AND 2000")
def _(s, d):
    docs = table(s, d, "documents")
    return search.filtered(docs, "doc_id", F.col("n_chars").between(1000, 2000)).join(docs.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source")


@query("ft_info_stats", f"WITH {ANALYZED} SELECT (SELECT count(*) FROM documents) AS num_docs, count(DISTINCT term) AS num_terms, CAST(sum(tf) AS BIGINT) AS num_tokens FROM postings")
def _(s, d):
    return index(s, d).info()


# ----------------------------------------------------------------------------------- vectors

Q0 = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
DIST = {
    "l2": "sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "ip": "-list_sum(list_transform(list_zip(e.embedding::DOUBLE[], qv), lambda p: p[1] * p[2]))",
    "cosine": "greatest(1 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], qv), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(qv, lambda x: x * x)) * list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))), 0)",
}


def base_vectors(s: SparkSession, d: str) -> tuple[DataFrame, object]:
    rows = table(s, d, "embeddings")
    first = rows.where("vec_id = 0").first()["embedding"]
    return rows, F.array(*(F.lit(float(x)) for x in first))


def _knn(metric: str):
    def plan(s, d):
        rows, q = base_vectors(s, d)
        return vectors.nearest(rows, q, 10, metric).select("vec_id", F.round("distance", 5).alias("distance"))

    return plan


for _metric, _sql in DIST.items():
    query(f"knn_{_metric}", f"WITH {Q0} SELECT vec_id, round({_sql}, 5) AS distance FROM embeddings e, q ORDER BY {_sql}, vec_id LIMIT 10")(_knn(_metric))


@query("knn_prefilter_label", f"WITH {Q0} SELECT vec_id, round({DIST['l2']}, 5) AS distance FROM embeddings e, q WHERE label = 3 ORDER BY {DIST['l2']}, vec_id LIMIT 5")
def _(s, d):
    rows, q = base_vectors(s, d)
    return vectors.nearest(rows.where("label = 3"), q, 5).select("vec_id", F.round("distance", 5).alias("distance"))


@query("vector_range", f"WITH {Q0} SELECT vec_id, round({DIST['cosine']}, 5) AS distance FROM embeddings e, q WHERE {DIST['cosine']} <= 0.8")
def _(s, d):
    rows, q = base_vectors(s, d)
    return vectors.within(rows, q, 0.8, "cosine").select("vec_id", F.round("distance", 5).alias("distance"))


@query("knn_per_query_batch", f"WITH qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query_id, e.vec_id, {DIST['l2']} AS dist FROM embeddings e, qs WHERE e.vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM x) SELECT query_id, rank, vec_id FROM r WHERE rank <= 3")
def _(s, d):
    rows = table(s, d, "embeddings")
    return vectors.nearest_per_query(rows, rows.where("vec_id % 50 = 0"), 3).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")


@query("knn_chunks_min", f"WITH {Q0} SELECT label AS doc_id, round(min({DIST['l2']}), 5) AS distance FROM embeddings e, q GROUP BY label ORDER BY min({DIST['l2']}), label LIMIT 4")
def _(s, d):
    rows, q = base_vectors(s, d)
    return vectors.nearest_chunks(rows.withColumnRenamed("label", "doc_id"), q, 4).select("doc_id", F.round("distance", 5).alias("distance"))


@query("vsim_attr_filter", f"WITH {Q0}, x AS (SELECT vec_id, greatest(0, least(1, 1 - ({DIST['cosine']}) / 2)) AS score FROM embeddings e, q WHERE label >= 2 AND label % 2 = 0) SELECT vec_id, round(score, 5) AS score FROM x ORDER BY x.score DESC, vec_id LIMIT 8")
def _(s, d):
    rows, q = base_vectors(s, d)
    found = vectors.similar(rows, q, 8, (F.col("label") >= 2) & (F.col("label") % 2 == 0))
    return found.select("vec_id", F.round("score", 5).alias("score"))


@query("vset_quant_sq8", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings) SELECT vec_id, array_to_string(list_transform(x, lambda a: CAST(CASE WHEN hi <= lo THEN 0 ELSE round((a - lo) / (hi - lo) * 255) END AS INTEGER)), ',') AS codes FROM v")
def _(s, d):
    rows = table(s, d, "embeddings")
    return rows.select("vec_id", F.array_join(F.transform(sq8(F.col("embedding")), lambda c: c.cast("string")), ",").alias("codes"))


@query("vset_binary_hamming", "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0) SELECT vec_id, CAST(list_sum(list_transform(list_zip(embedding, qv), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM embeddings, q")
def _(s, d):
    rows, q = base_vectors(s, d)
    return rows.select("vec_id", hamming(sign_bits(F.col("embedding")), sign_bits(q)).cast("int").alias("distance"))


@query("vset_info", "SELECT label, count(*) AS card, max(len(embedding)) AS dim FROM embeddings GROUP BY label")
def _(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("card"), F.max(F.size("embedding")).cast("long").alias("dim"))


@query("vector_product_codes")
def _(s, d):
    rows = table(s, d, "embeddings")
    return vectors.product_codes(rows, vectors.product_codebooks(rows, 4, 8)).select("vec_id", "code_0", "code_1", "code_2", "code_3")


MATRIX = vectors.projection_matrix(8, 64)
PROJECTED = ", ".join(f"round(list_sum(list_transform(list_zip(embedding::DOUBLE[], [{', '.join(map(repr, row))}]::DOUBLE[]), lambda p: p[1] * p[2])), 5) AS d{i}" for i, row in enumerate(MATRIX))


@query("vector_projection", f"SELECT vec_id, {PROJECTED} FROM embeddings")
def _(s, d):
    rows = vectors.random_projection(table(s, d, "embeddings"), 8)
    return rows.select("vec_id", *(F.round(F.col("embedding")[i], 5).alias(f"d{i}") for i in range(8)))


@query("vset_sq8_search", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings), c AS (SELECT vec_id, list_transform(x, lambda a: lo + CASE WHEN hi <= lo THEN 0 ELSE round((a - lo) / (hi - lo) * 255) END * (hi - lo) / 255.0::DOUBLE) AS y FROM v), q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), r AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(y, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM c, q) SELECT vec_id, round(dist, 5) AS distance FROM r ORDER BY dist, vec_id LIMIT 15")
def _(s, d):
    rows, q = base_vectors(s, d)
    return vectors.quantised_nearest(rows, q, 15).select("vec_id", F.round("distance", 5).alias("distance"))


@query("semantic_cache_hit", f"WITH {Q0}, c AS (SELECT vec_id AS entry_id, 'scope' || label AS scope, CASE WHEN vec_id % 4 = 0 THEN 1000 + vec_id END AS expire_at, 1 - {DIST['cosine']} AS sim FROM embeddings e, q WHERE vec_id > 0) SELECT entry_id, round(sim, 5) AS similarity FROM c WHERE (expire_at IS NULL OR expire_at > 1200) AND scope = 'scope2' AND sim >= 0.1 ORDER BY sim DESC, entry_id LIMIT 1")
def _(s, d):
    rows, q = base_vectors(s, d)
    cache = rows.where("vec_id > 0").select(F.col("vec_id").alias("entry_id"), F.concat(F.lit("scope"), "label").alias("scope"), F.when(F.col("vec_id") % 4 == 0, 1000 + F.col("vec_id")).alias("expire_at"), "embedding")
    return vectors.cached_answer(cache, q, 1200, "scope2", 0.1).select("entry_id", F.round("similarity", 5).alias("similarity"))


# ------------------------------------------------------------------------------------- fusion

LISTS = f"""{ANALYZED}, t AS (SELECT doc_id, sum(part) AS score FROM scored WHERE term IN ('stupid', 'license') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100),
{Q0}, v AS (SELECT vec_id AS doc_id, greatest(1 - ({DIST['cosine']}), 0) AS score FROM embeddings e, q ORDER BY 2 DESC, 1 LIMIT 100)"""


def both_lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = index(s, d)
    text = search.page(search.any_of(i.term("stupid"), i.term("license")), 100)
    rows, q = base_vectors(s, d)
    near = vectors.nearest(rows, q, 100, "cosine").select(F.col("vec_id").alias("doc_id"), F.greatest(1 - F.col("distance"), F.lit(0.0)).alias("score"))
    return text, near


@query("hybrid_rrf", f"WITH {LISTS}, a AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM t), b AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM v) SELECT doc_id, round(coalesce(a.s, 0) + coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b USING (doc_id)")
def _(s, d):
    return rounded(search.rrf(*both_lists(s, d)))


@query("hybrid_linear", f"WITH {LISTS}, a AS (SELECT doc_id, CASE WHEN max(score) OVER () - min(score) OVER () <= 1e-12 THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM t), b AS (SELECT doc_id, CASE WHEN max(score) OVER () - min(score) OVER () <= 1e-12 THEN score ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM v) SELECT doc_id, round(0.7::DOUBLE * coalesce(a.s, 0) + 0.3::DOUBLE * coalesce(b.s, 0), 5) AS score FROM a FULL JOIN b USING (doc_id)")
def _(s, d):
    return rounded(search.linear(*both_lists(s, d), 0.7, 0.3), 5)
