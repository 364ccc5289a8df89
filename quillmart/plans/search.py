"""Queries over passages, vectors and leads."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.columns import tidy_space
from quillmart.operators import effects, leads, receipts, retrieval
from quillmart.operators.storage import stored
from quillmart.plans.bases import PANEL
from quillmart.plans.registry import query
from quillmart.sources import tables
from quillmart.sources.tables import Tables

#: ASCII white space and the ends that trim takes.
TIDY = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT item_id, {TIDY} AS x FROM benchmark WHERE text IS NOT NULL), p AS (SELECT item_id, x, unnest(generate_series(0, length(x) - 1, 100)) AS i FROM t WHERE x <> '')
SELECT item_id, CAST(i // 100 AS INTEGER) AS part, substring(x, CAST(i AS INTEGER) + 1, 120) AS chunk FROM p WHERE trim(substring(x, CAST(i AS INTEGER) + 1, 120)) <> ''"""
)
def text_chunks(t: Tables) -> DataFrame:
    return retrieval.chunks(t.benchmark, "item_id", "text", 120, 20)


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, list_inner_product(e.embedding::DOUBLE[], q.v) AS score FROM embeddings e, q WHERE label < 6 ORDER BY score DESC, vec_id LIMIT 10""",
    "score",
)
def vector_top_k(t: Tables) -> DataFrame:
    """One query vector against the passages that the filter leaves."""
    q = t.embeddings.where("vec_id = 7").select(F.transform("embedding", lambda x: x.cast("double"))).first()[0]
    return retrieval.nearest(t.embeddings.where("label < 6"), "embedding", q, "vec_id", 10)


NEAR = """pairs AS (SELECT q.vec_id AS query, e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
near AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)"""


@query(f"WITH {NEAR} SELECT * FROM near WHERE rank <= 5", "score")
def vector_top_k_each(t: Tables) -> DataFrame:
    return retrieval.nearest_each(t.embeddings, t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding"), "vec_id", "query", "embedding", 5)


@query(
    f"""WITH {NEAR}, gold AS (SELECT q.vec_id AS query, e.vec_id, CASE WHEN e.label = q.label THEN 1 + e.vec_id % 3 ELSE 0 END AS grade FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id AND e.vec_id // 100 = q.vec_id // 100),
i AS (SELECT query, sum(CASE WHEN r <= 5 THEN (pow(2, grade) - 1) / log2(r + 1) END) AS ideal, count(*) FILTER (grade >= 1) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS r FROM gold) GROUP BY query),
h AS (SELECT n.query, count(*) FILTER (grade >= 1 AND rank <= 5) AS hits, min(rank) FILTER (grade >= 1) AS first, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg FROM near n JOIN gold g ON n.query = g.query AND n.vec_id = g.vec_id WHERE rank <= 20 GROUP BY n.query)
SELECT i.query, CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant END AS recall, CASE WHEN relevant > 0 THEN (coalesce(hits, 0) > 0)::INT::DOUBLE END AS hit, CASE WHEN relevant > 0 THEN coalesce(1 / first, 0.0) END AS mrr, CASE WHEN ideal > 0 THEN coalesce(dcg, 0.0) / ideal END AS ndcg FROM i LEFT JOIN h ON i.query = h.query""",
    "recall hit mrr ndcg",
)
def retrieval_metrics(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding", F.col("label").alias("_l"))
    ranked = retrieval.nearest_each(t.embeddings, q, "vec_id", "query", "embedding", 20)
    # each vector is judged for the queries of its hundred
    hundred = F.floor(F.col("vec_id") / 100).alias("_b")
    judged = q.select("*", F.floor(F.col("query") / 100).alias("_b")).join(t.embeddings.select("vec_id", "label", hundred), "_b").where("query <> vec_id")
    gold = judged.select("query", "vec_id", F.when(F.col("label") == F.col("_l"), (1 + F.col("vec_id") % 3)).otherwise(0).cast("int").alias("grade"))
    return retrieval.ranking_metrics(ranked, gold, "query", "vec_id", 5)


WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"


@query(
    f"""WITH q AS (SELECT item_id AS query, {WORDS.format()} AS w FROM benchmark), q1 AS (SELECT query, len(w) AS n, unnest(w) AS word FROM q), p AS (SELECT item_id, unnest({WORDS.format()}) AS word FROM benchmark),
s AS (SELECT query, item_id, count(*) / any_value(n) AS score FROM p JOIN q1 USING (word) GROUP BY 1, 2), r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "score",
)
def lexical_top_k(t: Tables) -> DataFrame:
    queries = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("asked"))
    return retrieval.lexical(t.benchmark, queries, "item_id", "text", "query", "asked", 5)


@query(
    """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'academic' ELSE 'vendor' END AS tier, 'axis' || CAST(label AS VARCHAR) AS axis, vec_id % 4 = 0 AS has_figure FROM embeddings)
SELECT tier, axis, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (has_figure) AS BIGINT) AS with_figure FROM p GROUP BY 1, 2"""
)
def passage_counts(t: Tables) -> DataFrame:
    return retrieval.tier_counts(_passages(t))


def _passages(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.when(F.col("vec_id") % 3 == 0, "academic").otherwise("vendor").alias("tier"), F.concat(F.lit("axis"), F.col("label").cast("string")).alias("axis"), (F.col("vec_id") % 4 == 0).alias("has_figure"))


@query(
    """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'academic' ELSE 'vendor' END AS tier, 'axis' || CAST(label AS VARCHAR) AS axis, vec_id % 4 = 0 AS has_figure FROM embeddings),
g AS (SELECT axis, CAST(count(*) AS BIGINT) AS figures, CAST(count(*) FILTER (vec_id % 7 = 0 AND label <> 2) AS BIGINT) AS specific FROM p JOIN embeddings USING (vec_id) WHERE tier = 'vendor' AND has_figure GROUP BY axis) SELECT *, specific = 0 AND figures > 0 AS shared_only FROM g"""
)
def axis_coverage(t: Tables) -> DataFrame:
    return retrieval.axis_coverage(_passages(t), (F.col("vec_id") % 7 == 0) & (F.col("axis") != "axis2"))


@query(
    """WITH r AS (SELECT label, vec_id, vec_id % 5 = 0 AS specific, CAST(vec_id * 7919 % 1000 AS DOUBLE) AS score, row_number() OVER (PARTITION BY label ORDER BY (vec_id % 5 = 0) DESC, vec_id * 7919 % 1000 DESC, vec_id) AS n FROM embeddings) SELECT label, vec_id, specific, score FROM r WHERE n <= 3""",
    "score",
)
def specific_evidence(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "vec_id", (F.col("vec_id") % 5 == 0).alias("specific"), (F.col("vec_id") * 7919 % 1000).cast("double").alias("score"))
    return retrieval.specific_first(rows, ["label"], "vec_id", 3)


@query(
    """SELECT vec_id, label_name, confidence FROM (SELECT vec_id, ['none', 'good', 'bad', 'mixed'][list_position(s, list_max(s))] AS label_name, 100 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) AS confidence FROM (SELECT vec_id, embedding[1:4]::DOUBLE[] AS s FROM embeddings)) WHERE label_name <> 'none'""",
    "confidence",
)
def aspect_labels(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("review"), F.lit("taste").alias("aspect"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("scores"))
    return effects.aspects(rows, ["none", "good", "bad", "mixed"]).select(F.col("review").alias("vec_id"), F.col("label").alias("label_name"), "confidence")


@query(
    """WITH f AS (SELECT vec_id AS review, 'a' || CAST(label % 3 AS VARCHAR) AS aspect, 'model' AS label, (vec_id * 37 % 100)::DOUBLE AS confidence FROM embeddings)
SELECT review, aspect, CASE WHEN confidence < 65 AND review % 2 = 0 THEN 'override' ELSE label END AS label, CASE WHEN confidence < 65 AND review % 2 = 0 THEN 90.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN confidence < 65 AND review % 2 = 0 THEN 'override' ELSE 'model' END AS source FROM f""",
    "confidence",
)
def refined_labels(t: Tables) -> DataFrame:
    f = t.embeddings.select(F.col("vec_id").alias("review"), F.concat(F.lit("a"), (F.col("label") % 3).cast("string")).alias("aspect"), F.lit("model").alias("label"), (F.col("vec_id") * 37 % 100).cast("double").alias("confidence"))
    return effects.refined(f, f.where("review % 2 = 0").select("review", "aspect", F.lit("override").alias("label"), F.lit(90.0).alias("confidence")))


# leads

LEADS = f"""{PANEL}, d AS (SELECT district, q, CAST(sum(CAST(sales AS DECIMAL(18,4))) AS DOUBLE) AS sales, sum(traffic) AS traffic, sum(stores) AS stores FROM panel GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY q DESC) AS n FROM d),
g AS (SELECT district, (max(sales) FILTER (n = 1) - max(sales) FILTER (n = 2)) / nullif(max(sales) FILTER (n = 2), 0) AS growth, max(traffic) FILTER (n = 1) AS traffic FROM r WHERE n <= 2 GROUP BY district),
leads AS (SELECT c_custkey AS lead, c_mktsegment AS industry, g.growth, g.traffic FROM customer LEFT JOIN g ON c_nationkey = district),
p AS (SELECT quantile_cont(growth, 0.9) AS p90, quantile_cont(growth, 0.7) AS p70, avg(growth) AS m FROM leads),
scored AS (SELECT lead, industry, growth, traffic, CASE WHEN growth IS NULL THEN 0.0::DOUBLE WHEN growth >= p90 THEN 100.0::DOUBLE WHEN growth >= p70 THEN 80.0::DOUBLE WHEN growth < 0 THEN 20.0::DOUBLE WHEN growth >= m THEN 60.0::DOUBLE ELSE 40.0::DOUBLE END AS growth_score,
  CASE WHEN traffic IS NOT NULL THEN CAST((rank() OVER (ORDER BY traffic NULLS LAST) + (count(*) OVER (PARTITION BY traffic) - 1) / 2.0) / count(traffic) OVER () * 100 AS DOUBLE) END AS traffic_score FROM leads, p)"""


def _leads(t: Tables) -> DataFrame:
    from quillmart.functions.columns import exact_sum
    from quillmart.operators import panel

    d = tables.panel(t).groupBy("district", "q").agg(exact_sum("sales").alias("sales"), F.sum("traffic").alias("traffic"), F.sum("stores").alias("stores"))
    g = panel.observed_growth(d, ["district"], "sales", "q").join(panel.latest(d, ["district"], "q", ["traffic"]), "district")
    c = t.customer.select(F.col("c_custkey").alias("lead"), F.col("c_mktsegment").alias("industry"), F.col("c_nationkey").alias("district"))
    rows = stored(c.join(g, "district", "left").select("lead", "industry", "district", "growth", "traffic"), "leads")
    return leads.percentile_scores(leads.growth_scores(rows, "growth"), "traffic", "traffic_score")


@query(f"WITH {LEADS} SELECT lead, growth, traffic, growth_score, traffic_score, growth_score * (0.30::DOUBLE / 0.8::DOUBLE) + traffic_score * (0.25::DOUBLE / 0.8::DOUBLE) + 50.0::DOUBLE * (0.25::DOUBLE / 0.8::DOUBLE) AS score FROM scored ORDER BY score DESC NULLS LAST, lead LIMIT 50", "growth traffic growth_score traffic_score score")
def lead_scores(t: Tables) -> DataFrame:
    """Leads before reviews are known, without heroes: a similarity of 50 stands in."""
    score = leads.preliminary(F.col("growth_score"), F.col("traffic_score"), F.lit(50.0))
    return _leads(t).withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), "lead").limit(50).select("lead", "growth", "traffic", "growth_score", "traffic_score", "score")


@query(
    """WITH s AS (SELECT s_suppkey AS hero, s_acctbal AS growth, 3.5::DOUBLE + s_suppkey % 4 * 0.4::DOUBLE AS rating, 0.4::DOUBLE + s_suppkey % 5 * 0.2::DOUBLE AS rating_sd FROM supplier) SELECT * FROM s WHERE growth >= (SELECT quantile_cont(growth, 0.8) FROM s) AND rating_sd <= 1 AND rating >= 4""",
    "growth rating rating_sd",
)
def hero_stores(t: Tables) -> DataFrame:
    return leads.heroes(_stores(t)).select("hero", "growth", "rating", "rating_sd")


def _stores(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("hero"), F.col("s_acctbal").alias("growth"), (3.5 + k % 4 * 0.4).alias("rating"), (0.4 + k % 5 * 0.2).alias("rating_sd"), F.concat(F.lit("seg"), (k % 5).cast("string")).alias("industry"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("city"))


PCT = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


@query(
    f"""WITH s AS (SELECT s_suppkey AS id, s_acctbal AS growth, 'seg' || CAST(s_suppkey % 5 AS VARCHAR) AS industry, 'n' || CAST(s_nationkey AS VARCHAR) AS city, true AS hero FROM supplier WHERE s_acctbal >= (SELECT quantile_cont(s_acctbal, 0.8) FROM supplier) AND 0.4 + s_suppkey % 5 * 0.2::DOUBLE <= 1 AND 3.5 + s_suppkey % 4 * 0.4::DOUBLE >= 4),
c AS (SELECT c_custkey AS id, c_acctbal AS growth, 'seg' || CAST(c_custkey % 5 AS VARCHAR) AS industry, 'n' || CAST(c_nationkey AS VARCHAR) AS city, false AS hero FROM customer),
a AS (SELECT *, {PCT.format("growth")} AS g, {PCT.format("0.0")} AS z FROM (SELECT * FROM s UNION ALL SELECT * FROM c)),
p AS (SELECT x.id, ((x.industry = y.industry)::INT + (x.city = y.city)::INT + x.g * y.g + x.z * y.z) / (sqrt(2 + x.g * x.g + x.z * x.z) * sqrt(2 + y.g * y.g + y.z * y.z)) AS sim FROM a x JOIN a y ON NOT x.hero AND y.hero),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC) AS n FROM p)
SELECT id AS lead, (avg(sim) + 1) / 2 * 100 AS similarity FROM k WHERE n <= 5 GROUP BY id""",
    "similarity",
)
def hero_similarity(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("lead"), F.col("c_acctbal").alias("growth"), F.lit(0.0).alias("reviews"), F.concat(F.lit("seg"), (F.col("c_custkey") % 5).cast("string")).alias("industry"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("city"))
    best = leads.heroes(_stores(t)).withColumn("reviews", F.lit(0.0))
    return leads.similarity(c, best, "lead", ["growth", "reviews"])


REVIEWED = f"""{LEADS}, s AS (SELECT lead, growth_score, traffic_score, 50.0::DOUBLE AS similarity FROM scored), st AS (SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_custkey ELSE -c_custkey END AS lead, (c_custkey % 40)::DOUBLE AS review_count, 3 + c_custkey % 20 / 10.0::DOUBLE AS avg_rating, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 90 END AS days_since, -(c_custkey % 13)::DOUBLE AS review_trend FROM customer),
j AS (SELECT s.*, st.review_count AS rc, coalesce(review_count, 0) AS a, coalesce(avg_rating, 0) AS b, -coalesce(days_since, (SELECT max(days_since) FROM st))::DOUBLE AS c, coalesce(review_trend, 0) AS d FROM s LEFT JOIN st ON s.lead = st.lead),
k AS (SELECT *, 100 * (0.4 * {PCT.format("a")} + 0.3 * {PCT.format("b")} + 0.2 * {PCT.format("c")} + 0.1 * {PCT.format("d")}) AS review_score FROM j)"""


@query(f"WITH {REVIEWED} SELECT lead, review_score, growth_score * 0.30 + traffic_score * 0.25 + review_score * 0.20 + similarity * 0.25 AS final_score FROM k WHERE rc IS NOT NULL", "review_score final_score")
def reviewed_leads(t: Tables) -> DataFrame:
    """Every fourth customer's reviews stand under a key that is no lead, so those leads have none."""
    k = F.col("c_custkey")
    stats = t.customer.select(F.when(k % 4 != 0, k).otherwise(-k).alias("lead"), (k % 40).cast("double").alias("review_count"), (3 + k % 20 / 10).alias("avg_rating"), F.when(k % 9 != 0, (k % 90)).alias("days_since"), (-(k % 13)).cast("double").alias("review_trend"))
    scored = _leads(t).select("lead", "growth_score", "traffic_score", F.lit(50.0).alias("similarity"))
    return leads.with_reviews(scored, stats, "lead").select("lead", "review_score", "final_score")


@query(
    """WITH h AS (SELECT s_suppkey AS hero, 'seg' || CAST(s_suppkey % 5 AS VARCHAR) AS industry, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS n FROM supplier)
SELECT c_custkey AS lead, hero, CAST(n AS INTEGER) AS rank FROM customer JOIN h ON h.industry = 'seg' || CAST(c_custkey % 5 AS VARCHAR) WHERE n <= 3"""
)
def hero_examples(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("lead"), F.concat(F.lit("seg"), (F.col("c_custkey") % 5).cast("string")).alias("industry"))
    return leads.hero_examples(rows, _stores(t), "lead")


@query(
    """SELECT part, seen, lev, 1 - lev / greatest(length(name), length(seen)) AS likeness FROM (SELECT p_partkey AS part, p_name AS name, translate(p_name, 'aeinos', '43l') AS seen, CAST(levenshtein(p_name, translate(p_name, 'aeinos', '43l')) AS INTEGER) AS lev FROM part)""",
    "likeness",
)
def edit_distances(t: Tables) -> DataFrame:
    """Character errors of recognised names against the true ones: every part's name, misread letter by letter."""
    seen = t.part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.translate("p_name", "aeinos", "43l").alias("seen")).withColumn("lev", F.levenshtein("name", "seen"))
    return seen.select("part", "seen", "lev", (1 - F.col("lev") / F.greatest(F.length("name"), F.length("seen"))).alias("likeness"))


@query()
def product_name_likeness(t: Tables) -> DataFrame:
    """Every part's name against that of the next part, by characters and their letters; checked by the tests."""
    a = t.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), (F.col("p_partkey") + 1).alias("b"))
    both = a.join(t.part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), "b")
    return both.select("a", "b", receipts.name_likeness("x", "y").alias("score"))


@query(
    f"""SELECT item_id, CAST(length({TIDY}) AS INTEGER) AS size FROM benchmark"""
)
def tidy_texts(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.length(tidy_space(F.col("text"))).alias("size"))
