"""Relation building between entities: exact names and Jaccard similarity of token sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / F.when(union > 0, union)).otherwise(0.0)


def keyword_set(text: Column | str) -> Column:
    """A JSON array kept in a string, as a set; malformed text is empty."""
    return F.array_distinct(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")))


def word_set(text: Column | str) -> Column:
    """White-space separated words, case-sensitive, as a set."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for ids a < b with a similarity above the threshold; sets has id and tokens.

    Prefix filtering: tokens are ordered by rarity; a pair above the threshold shares one of the first
    size - ceil(threshold * size) + 1 tokens of both, so only those are joined, and the length bound is part
    of the join. Equal sets are joined once for all their ids and expanded at the end.
    """
    rows = sets.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).where(F.size("tokens") > 0)
    distinct = rows.groupBy("tokens").agg(F.min("id").alias("rep"))
    freq = distinct.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    flat = distinct.select("rep", F.explode("tokens").alias("t")).join(freq, "t")
    ranked = flat.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o")).select("rep", F.transform("o", lambda x: x["t"]).alias("o"))
    size = F.size("o")
    prefix = F.slice("o", F.lit(1), (size - F.ceil(F.lit(threshold) * size) + 1).cast("int"))
    keyed = ranked.select("rep", size.alias("n"), F.explode(prefix).alias("t"))
    a, b = keyed.select(F.col("rep").alias("a"), F.col("n").alias("na"), "t"), keyed.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "t")
    near = a.join(b, "t").where((F.col("a") < F.col("b")) & (F.least("na", "nb") > threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    left, right = distinct.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), distinct.select(F.col("rep").alias("b"), F.col("tokens").alias("y"))
    score = near.join(left, "a").join(right, "b").withColumn("similarity", jaccard("x", "y")).where(F.col("similarity") > threshold).select("x", "y", "similarity")
    same = distinct.select(F.col("tokens").alias("x"), F.col("tokens").alias("y"), F.lit(1.0).alias("similarity")).where(F.lit(threshold) < 1)
    both = score.unionByName(same)
    ids = rows.select("id", "tokens")
    return (
        both.join(ids.select(F.col("tokens").alias("x"), F.col("id").alias("p")), "x")
        .join(ids.select(F.col("tokens").alias("y"), F.col("id").alias("q")), "y")
        .where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
        .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
    )


def derived_from(papers: DataFrame, skills: DataFrame) -> DataFrame:
    """(source_id, target_id): paper entities whose skill_created is a skill's exact name."""
    made = papers.select(F.col("id").alias("source_id"), F.get_json_object("properties", "$.skill_created").alias("name"))
    return made.join(skills.select(F.col("id").alias("target_id"), "name"), "name").select("source_id", "target_id")
