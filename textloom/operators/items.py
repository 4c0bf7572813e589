"""Reports over a table of items: scores, ranks, counts by group, repeated names, thin entries, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: names of options that must not travel in a URL.
SECRET = r"(?i)(^|[^a-z])(pass(phrase|word|wd)?|secret|token|apikey|api_key|privatekey|private_key|credential|salt)([^a-z]|$)"
# Fixed value: pictures that may be shown, by their data URL.
PICTURE = r"^data:image/(png|jpe?g|webp);base64,[A-Za-z0-9+/=\s]+$"


def score_verdict(total: Column) -> Column:
    return F.when(total >= 40, "build-now").when(total >= 30, "backlog").when(total >= 20, "cluster-only").otherwise("skip")


def is_secret(name: Column) -> Column:
    return name.rlike(SECRET)


def safe_picture(c: Column) -> Column:
    return F.when(c.rlike(PICTURE), c)


def live(items: DataFrame, status: str = "status") -> DataFrame:
    return items.where(F.col(status) == "live")


def visible(items: DataFrame, status: str = "status") -> DataFrame:
    """What a lookup finds: all but what is deprecated."""
    return items.where(~F.col(status).eqNullSafe("deprecated"))


def top_items(items: DataFrame, score: str, name: str, limit: int = 12) -> DataFrame:
    return items.orderBy(F.desc(score), name).limit(limit)


def top_in_group(items: DataFrame, group: str, score: str, name: str, limit: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), name)
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def repeated(items: DataFrame, *names: str) -> DataFrame:
    """The names that more than one item has, and how many."""
    return items.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")


def group_counts(items: DataFrame, group: str, updated: str) -> DataFrame:
    """group, n, newest; a row of null group, with overall true, for all."""
    found = items.rollup(group).agg(F.grouping(group).alias("_all"), F.count("*").alias("n"), F.max(updated).alias("newest"))
    return found.select(group, (F.col("_all") == 1).alias("overall"), "n", "newest")


def health(items: DataFrame, group: str, status: str = "status") -> DataFrame:
    """One row: items, live ones, groups with a live one."""
    is_live = F.col(status) == "live"
    return items.agg(F.count("*").alias("items"), F.count_if(is_live).alias("live"), F.countDistinct(F.when(is_live, F.col(group))).alias("groups"))


def thin(items: DataFrame, key: str, rules: list[tuple[Column, Column]]) -> DataFrame:
    """key, issues of the items that break a rule (condition, what is said)."""
    said = F.array_compact(F.array(*(F.when(bad, text) for bad, text in rules)))
    return items.select(key, said.alias("issues")).where(F.size("issues") > 0)


def next_steps(items: DataFrame, explicit: DataFrame, key: str, cluster: str, rank: str, limit: int = 3) -> DataFrame:
    """key, other, place: explicit links (key, other, at) in their order, as often as they are told, then the best of the cluster."""
    named = explicit.join(items.select(F.col(key).alias("other")), "other").select(key, "other", F.lit(1).alias("kind"), F.col("at").cast("double").alias("by"))
    w = Window.partitionBy(cluster).orderBy(F.desc(rank), key)
    # of a cluster no more are needed than fill the list beside oneself and the explicit ones, of which fewer than limit count
    best = items.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * limit).select(cluster, F.col(key).alias("other"), F.col("r").cast("double").alias("by"))
    filler = items.select(key, cluster).join(best, cluster).where(F.col(key) != F.col("other")).join(named.select(key, "other"), [key, "other"], "left_anti").select(key, "other", F.lit(2).alias("kind"), "by")
    own = Window.partitionBy(key).orderBy("kind", "by", "other")
    return named.union(filler).withColumn("place", F.row_number().over(own)).where(F.col("place") <= limit).select(key, "other", "place")


def missing(wanted: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """What is wanted of each key and not held."""
    return wanted.join(held.select(key, value), [key, value], "left_anti")


def completeness(done: dict[str, Column]) -> dict[str, Column]:
    """done, total and missing (names) of the parts that an item should have."""
    gaps = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in done.items())))
    return {"done": F.lit(len(done)) - F.size(gaps), "total": F.lit(len(done)), "missing": gaps}


def weighted_mode(df: DataFrame, key: str, value: Column, weight: Column, order: str, default: float = 10.0) -> DataFrame:
    """key, mode: the value, in steps of a half, of the largest summed weight; the first seen on a tie, of those the least."""
    step = F.floor(value * 2 + F.lit(0.5)) / 2.0
    sums = df.groupBy(key, step.alias("_v")).agg(F.sum(weight).alias("_w"), F.min(order).alias("_at"))
    best = sums.groupBy(key).agg(F.max_by("_v", F.struct(F.col("_w"), -F.col("_at"), -F.col("_v"))).alias("_best"))
    return best.select(key, F.when(F.coalesce(F.col("_best"), F.lit(0.0)) == 0, default).otherwise(F.col("_best")).alias("mode"))
