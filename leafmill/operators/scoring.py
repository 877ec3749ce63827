"""Scores and choices over tables of features: privacy, preflight, compression, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each finding weighs.
WEIGHTS = {
    "author": 8, "subject": 8, "keywords": 8, "creator": 5, "producer": 5, "created": 3, "modified": 3, "title": 2,
    "xmp": 10, "javascript": 15, "attachments": 12, "forms": 6, "signatures": 4, "gps": 20, "exif": 2,
}
#: Compression profiles as (name, dpi, jpeg quality), strongest last.
PROFILES = (("light", 220, 88), ("medium", 150, 80), ("heavy", 96, 65), ("retry-1", 72, 52), ("retry-2", 56, 42))
KIB, MIB = 1024, 1024 * 1024


def findings(features: DataFrame) -> DataFrame:
    """doc_id, id, weight: one row per finding of the boolean and count columns of ``features``.

    Annotations weigh min(12, 6 + count), links min(8, count); EXIF counts only without GPS."""
    one = lambda name, test, weight: F.when(test, F.struct(F.lit(name).alias("id"), F.lit(weight).cast("int").alias("weight") if isinstance(weight, int) else weight.cast("int").alias("weight")))
    parts = [one(k, F.col(k), w) for k, w in WEIGHTS.items() if k not in ("gps", "exif")]
    parts += [
        one("annotations", F.col("n_annotations") > 0, F.least(F.lit(12), 6 + F.col("n_annotations"))),
        one("links", F.col("n_links") > 0, F.least(F.lit(8), F.col("n_links"))),
        one("gps", F.col("gps"), WEIGHTS["gps"]),
        one("exif", F.col("exif") & ~F.col("gps"), WEIGHTS["exif"]),
    ]
    return features.select("doc_id", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.*")


#: The kinds of objects that are counted, not only seen.
COUNTED = {"n_annotations": "annotation", "n_links": "link"}


def features_of(objects: DataFrame) -> DataFrame:
    """The features of ``findings`` counted from a document's objects (doc_id, kind, action).

    A kind is one of WEIGHTS, ``annotation`` or ``link``; an annotation whose action opens an address is a link too, and an object
    of any kind whose action runs a script is a finding of JavaScript. Unknown kinds count nowhere."""
    action = F.lower(F.coalesce("action", F.lit("")))
    o = objects.select("doc_id", "kind", (action == "uri").alias("_opens"), (action == "javascript").alias("_runs"))
    seen = lambda test: F.coalesce(F.max(test), F.lit(False))
    flags = [seen((F.col("kind") == k) | (F.col("_runs") if k == "javascript" else F.lit(False))).alias(k) for k in WEIGHTS]
    link = (F.col("kind") == COUNTED["n_links"]) | ((F.col("kind") == COUNTED["n_annotations"]) & F.col("_opens"))
    counts = [F.count_if(F.col("kind") == COUNTED["n_annotations"]).alias("n_annotations"), F.count_if(link).alias("n_links")]
    return o.groupBy("doc_id").agg(*flags, *counts)


def privacy_scores(features: DataFrame) -> DataFrame:
    """doc_id, n_findings, score = max(0, 100 - sum of weights)."""
    f = findings(features).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    out = features.select("doc_id").join(f, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_findings"), F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0))).alias("score"))


def preflight(n_bytes: Column, pages: Column, images: Column, optimized: Column) -> Column:
    """struct(content, compressibility, memory_risk, time_class) of a document's features."""
    a_page = n_bytes / F.greatest(pages, F.lit(1))
    content = F.when(images >= F.greatest(F.lit(1), pages), "image-heavy").when(images > 0, "mixed").otherwise("text")
    low = optimized & (a_page < 300 * KIB)
    press = F.when(low, "low").when((content == "image-heavy") | (a_page > 750 * KIB), "high").when((images > 0) | (a_page > 200 * KIB), "moderate").otherwise("low")
    memory = 4 * n_bytes + 64 * MIB
    work = pages + n_bytes / (2 * MIB)
    return F.struct(
        content.alias("content"), press.alias("compressibility"),
        F.when(memory > 600 * MIB, "high").when(memory > 250 * MIB, "moderate").otherwise("low").alias("memory_risk"),
        F.when(work > 120, "long").when(work > 25, "moderate").otherwise("short").alias("time_class"),
    )


def target_profiles(n_bytes: Column, target: Column, most: int = 4) -> Column:
    """The names of the profiles to try for a target size, at most four, mildest first."""
    ratio = target / n_bytes
    first = F.when(ratio >= 0.65, F.lit(1)).when(ratio >= 0.3, F.lit(2)).otherwise(F.lit(3))
    names = F.array(*[F.lit(n) for n, _, _ in PROFILES])
    chosen = F.concat(F.slice(names, first, F.lit(4) - first), F.slice(names, 4, 2))
    return F.slice(chosen, 1, most)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of the attempts (doc_id, attempt, in_bytes, out_bytes, target), the smallest, the first of
    equals: with saved bytes, percent to one decimal half up, and whether the target is met."""
    b = attempts.groupBy("doc_id").agg(F.min(F.struct("out_bytes", "attempt", "in_bytes", "target")).alias("b")).select("doc_id", "b.*")
    saved = F.greatest(F.lit(0), F.col("in_bytes") - F.col("out_bytes"))
    percent = F.floor(saved / F.col("in_bytes") * 1000 + 0.5) / 10
    return b.select("doc_id", "attempt", "out_bytes", saved.alias("saved"), percent.alias("percent"), (saved > 0).alias("beneficial"), (F.col("out_bytes") <= F.col("target")).alias("target_reached"))


def otsu(histogram: DataFrame) -> DataFrame:
    """image_id, threshold from (image_id, level, n): the first level that best parts dark from light; 127 for flat images."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id")
    upto = w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    n, s = F.sum("n").over(upto), F.sum(F.col("n") * F.col("level")).over(upto)
    all_n, all_s = F.sum("n").over(w), F.sum(F.col("n") * F.col("level")).over(w)
    h = histogram.select("image_id", "level", n.alias("b"), s.alias("sb"), all_n.alias("t"), all_s.alias("st")).withColumn("f", F.col("t") - F.col("b"))
    apart = F.when((F.col("b") > 0) & (F.col("f") > 0), F.col("b") * F.col("f") * F.pow(F.col("sb") / F.col("b") - (F.col("st") - F.col("sb")) / F.col("f"), F.lit(2.0))).otherwise(0.0)
    best = h.withColumn("v", apart).groupBy("image_id").agg(F.max("v").alias("v"), F.max(F.struct("v", -F.col("level"))).alias("m"))
    return best.select("image_id", F.when(F.col("v") > 0, -F.col("m.col2")).otherwise(127).cast("int").alias("threshold"))


def character_accuracy(expected: Column, actual: Column) -> Column:
    """1 less the edit distance by the expected length, 0 at least."""
    n = F.length(expected)
    return F.when(n == 0, F.when(F.length(actual) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(expected, actual) / n))


def search_catalog(tools: DataFrame, query: str) -> DataFrame:
    """Tools whose name, description, tags or category hold every word of the query."""
    hay = F.lower(F.concat_ws(" ", "name", "description", F.array_join("tags", " "), "category"))
    words = query.lower().split()
    for w in words:
        tools = tools.where(F.contains(hay, F.lit(w)))
    return tools


def related_tools(tools: DataFrame, tool_id: str) -> DataFrame:
    """The available tools that a tool names as related, in its order."""
    ids = tools.where(F.col("id") == tool_id).select(F.posexplode("related").alias("pos", "_id"))
    return ids.join(tools.where("available"), F.col("_id") == F.col("id")).orderBy("pos").select("pos", "id", "name")
