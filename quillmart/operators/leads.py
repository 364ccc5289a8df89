"""Scoring new leads: growth, traffic, reviews and similarity to the best stores, weighted into one score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.classify import growth_points
from quillmart.operators import ranking
from quillmart.operators.storage import stored

#: Weights of the parts of the score, of the traffic index and of review activity; what a hero store needs.
WEIGHTS = {"growth": 0.30, "traffic": 0.25, "review": 0.20, "similarity": 0.25}
DAYPARTS = {"morning": 0.3, "lunch": 0.3, "afternoon": 0.4}
ACTIVITY = {"review_count": 0.4, "avg_rating": 0.3, "recency": 0.2, "review_trend": 0.1}
HERO_GROWTH, HERO_SPREAD, HERO_RATING, NEAREST = 0.80, 1.0, 4.0, 5
#: Words that put a trade's free text into one group, the first that fits.
INDUSTRIES = [
    ("카페/베이커리", ["카페", "커피", "베이커리", "제과", "디저트", "빵"]),
    ("치킨", ["치킨", "통닭"]),
    ("한식", ["한식"]),
    ("중식", ["중식", "중국"]),
    ("일식", ["일식", "돈까스", "초밥", "스시", "라멘"]),
    ("양식/피자", ["양식", "피자", "파스타", "스테이크"]),
    ("분식", ["분식"]),
    ("주점", ["주점", "호프", "포차", "술집"]),
    ("패스트푸드", ["패스트푸드", "버거", "샌드위치"]),
    ("미용", ["미용", "네일", "헤어", "피부", "뷰티"]),
    ("편의점/마트", ["편의점", "마트", "슈퍼"]),
]
UNKNOWN = "__unknown__"


def industry_group(text: Column) -> Column:
    """The first group one of whose words the text holds, else the text itself; null and blank are unknown."""
    t = F.trim(text)
    out = F.when(t.isNull() | (t == ""), UNKNOWN)
    for name, words in INDUSTRIES:
        out = out.when(t.rlike("|".join(words)), name)
    return out.otherwise(t)


def city_part(address: Column) -> Column:
    """The part of an address that ends in 구; null without one."""
    return F.nullif(F.regexp_extract(address, r"[가-힣]+구", 0), F.lit(""))


def traffic_index(df: DataFrame) -> Column:
    return sum((F.col(c) * w for c, w in DAYPARTS.items()), F.lit(0.0))


def growth_scores(df: DataFrame, rate: str, out: str = "growth_score") -> DataFrame:
    """Five buckets of the rate: tenth and thirtieth percentiles from the top, falling, at least the mean, the rest; null scores 0."""
    p70, p90 = ranking.quantiles(df, rate, [0.7, 0.9])
    mean = df.agg(F.avg(rate).alias("m")).first()["m"]
    lit = lambda v: F.lit(v).cast("double")
    return df.withColumn(out, growth_points(F.col(rate), lit(p90), lit(p70), lit(mean)))


def percentile_scores(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percentile among all rows, from 0 to 100; null for null."""
    return ranking.global_percentile(df, value, out).withColumn(out, F.col(out) * 100)


def heroes(stores: DataFrame) -> DataFrame:
    """Stores in the top fifth of growth whose ratings are high and steady; a missing figure disqualifies."""
    cut = ranking.quantiles(stores, "growth", [HERO_GROWTH])[0]
    return stores.where((F.col("growth") >= F.lit(cut).cast("double")) & (F.col("rating_sd") <= HERO_SPREAD) & (F.col("rating") >= HERO_RATING))


def city_means(candidates: DataFrame, city: str, columns: list[str]) -> DataFrame:
    return candidates.groupBy(city).agg(*(F.avg(c).alias(c) for c in columns))


def similarity(candidates: DataFrame, best: DataFrame, key: str, numbers: list[str], k: int = NEAREST) -> DataFrame:
    """(key, similarity): mean cosine of the ``k`` most similar hero stores, on a scale from 0 to 100; 0 without heroes.

    A row's vector is one-hot industry and city and the percentiles of ``numbers`` over both tables, null read as 0. A
    one-hot product is an equality, so vectors are never widened. Equal vectors are compared once, a hero's standing for
    up to ``k`` of its kind. Every other candidate meets every hero: heroes are dealt over blocks of 512 and candidates
    over groups of 65,536, and a block meets a group in one task that hands on a candidate's ``k`` best of the block.
    """
    a = candidates.select(F.col(key).cast("string").alias("_id"), F.lit(False).alias("_is"), "industry", "city", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers))
    b = best.select(F.monotonically_increasing_id().cast("string").alias("_id"), F.lit(True).alias("_is"), "industry", "city", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers))
    rows = stored(a.union(b), "vectors")
    for c in numbers:
        rows = ranking.global_percentile(rows, c, f"_{c}")
    norm = F.sqrt(F.lit(2.0) + sum((F.col(f"_{c}") * F.col(f"_{c}") for c in numbers), F.lit(0.0)))
    rows = stored(rows.select("_id", "_is", F.coalesce("industry", F.lit(UNKNOWN)).alias("_i"), F.coalesce("city", F.lit(UNKNOWN)).alias("_c"), F.array(*(f"_{c}" for c in numbers)).alias("_v"), norm.alias("_n")), "vectors")
    # one row a vector, with how many of it count
    kinds = rows.groupBy("_is", "_i", "_c", "_v", "_n").agg(F.least(F.count("*"), F.lit(k)).alias("_times"))
    kinds = stored(kinds.withColumn("_at", F.monotonically_increasing_id()), "vectors")
    size = kinds.agg(F.count(F.when(F.col("_is"), 1)).alias("heroes"), F.count("*").alias("all")).first()
    if not (n := size["heroes"]):
        return candidates.select(key, F.lit(0.0).alias("similarity"))
    blocks, groups = max(1, n // 512), max(1, (size["all"] - n) // 65_536)
    dealt = lambda k: F.pmod(F.xxhash64("_at"), F.lit(k)).cast("int")
    copied = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = kinds.where("not _is").select("*", dealt(groups).alias("_g"), copied(blocks).alias("_b"))
    right = kinds.where("_is").select("*", copied(groups).alias("_g"), dealt(blocks).alias("_b"))
    sims = left.unionByName(right).groupBy("_b", "_g").applyInArrow(lambda cell: _nearest(cell, k), "_at long, _s double")
    top = sims.withColumn("_r", F.row_number().over(Window.partitionBy("_at").orderBy(F.col("_s").desc()))).where(F.col("_r") <= k)
    means = top.groupBy("_at").agg(((F.avg("_s") + 1) / 2 * 100).alias("similarity"))
    means = kinds.where("not _is").join(means, "_at").select("_i", "_c", "_v", "similarity")
    means = rows.where("not _is").join(means, ["_i", "_c", "_v"]).groupBy("_id").agg(F.max("similarity").alias("similarity"))
    return candidates.select(key).join(means, F.col(key).cast("string") == F.col("_id"), "left").select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def _nearest(t: pa.Table, k: int) -> pa.Table:
    """(_at, _s): the ``k`` greatest cosines of each candidate with the heroes of one block."""
    hero = t["_is"].to_numpy()
    a, b = np.flatnonzero(~hero), np.repeat(np.flatnonzero(hero), t["_times"].to_numpy()[hero])
    same = [np.unique(np.array(t[c].to_pylist(), object), return_inverse=True)[1] for c in ("_i", "_c")]
    v, norm = np.array(t["_v"].to_pylist(), float).reshape(len(t), -1).T, t["_n"].to_numpy()
    m = min(k, len(b))
    best = [np.zeros((0, m))]
    for part in np.array_split(a, len(a) * len(b) // 1_000_000 + 1):
        x = part[:, None]
        s = sum(((c[x] == c[b]).astype(float) for c in same), 0.0)
        s = s + sum((c[x] * c[b] for c in v), 0.0)
        best.append(np.partition(s / (norm[x] * norm[b]), len(b) - m, axis=1)[:, len(b) - m :] if m else np.zeros((len(part), 0)))
    return pa.table({"_at": np.repeat(t["_at"].to_numpy()[a], m), "_s": np.concatenate(best).ravel()})


def preliminary(growth: Column, traffic: Column, similar: Column) -> Column:
    """Without reviews, the other weights make up the whole."""
    whole = WEIGHTS["growth"] + WEIGHTS["traffic"] + WEIGHTS["similarity"]
    return growth * (WEIGHTS["growth"] / whole) + traffic * (WEIGHTS["traffic"] / whole) + similar * (WEIGHTS["similarity"] / whole)


def final(growth: Column, traffic: Column, review: Column, similar: Column) -> Column:
    return growth * WEIGHTS["growth"] + traffic * WEIGHTS["traffic"] + review * WEIGHTS["review"] + similar * WEIGHTS["similarity"]


def with_reviews(scored: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Leads with a review score and the final one; leads without reviews go, unless no reviews came at all: then nothing changes.

    ``stats(key, review_count, avg_rating, days_since, review_trend)``. A missing recency is the longest of all, other
    missing figures are 0, before percentiles are taken over all leads.
    """
    if stats.isEmpty():
        return scored
    rows = scored.join(stats, key, "left")
    longest = rows.agg(F.max("days_since").alias("m")).first()["m"]
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = rows.withColumns({"_review_count": zero("review_count"), "_avg_rating": zero("avg_rating"), "_recency": -F.coalesce(F.col("days_since").cast("double"), F.lit(float(longest or 0.0))), "_review_trend": zero("review_trend")})
    rows = stored(rows, "reviewed")
    for c in ACTIVITY:
        rows = percentile_scores(rows, f"_{c}", f"_{c}_p")
    score = sum((F.col(f"_{c}_p") * w for c, w in ACTIVITY.items()), F.lit(0.0))
    rows = rows.where(F.col("review_count").isNotNull()).withColumn("review_score", score)
    rows = rows.withColumn("final_score", final(F.col("growth_score"), F.col("traffic_score"), F.col("review_score"), F.col("similarity")))
    return rows.select(*scored.columns, *(c for c in ("review_score", "final_score") if c not in scored.columns))


def to_records(ranked: DataFrame) -> DataFrame:
    """What is handed on: leads with a name, an address and a score; the trade is the middle class, else the large one."""
    kept = ranked.where(F.col("name").isNotNull() & F.col("address").isNotNull() & F.col("final_score").isNotNull() & ~F.isnan("final_score"))
    return kept.withColumn("trade", F.coalesce("middle_class", "large_class"))


def hero_examples(rows: DataFrame, best: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, hero, rank): up to ``k`` heroes of the lead's industry, by id."""
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("industry").orderBy("hero"))).where(F.col("rank") <= k)
    return rows.select(key, "industry").join(first.select("industry", "hero", "rank"), "industry").select(key, "hero", "rank")


def score_medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the batch's median of each score, nulls ignored."""
    middle = ranking.quantiles_of(rows, dict.fromkeys(columns, [0.5]))
    return rows.sparkSession.createDataFrame([tuple(middle[c][0] for c in columns)], ", ".join(f"{c} double" for c in columns))
