"""Set-similarity join of texts by an inverted index with a prefix filter, and the three-rule contamination audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions.text import content_tokens, norm_exact, tokens


def jaccard_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float) -> DataFrame:
    """(left_id, right_id, jaccard) of token sets at or over the threshold, both sides as (id, tokens); right is the smaller side.

    Sets of left that are too short or too long for any of right drop out first. Of a set of n tokens only the rarest
    n - ceil(t n) + 1 are indexed: two sets at or over the threshold share one of these, so frequent tokens, the ones every
    text has, are hardly ever joined on. Frequencies are those of right, whose tokens alone are read of left: tokens that
    right lacks are the rarest of all and match nothing. Empty sets match nothing.
    """
    b = right.select(F.col(right_id).alias("b"), F.col("tokens").alias("tb"), F.size("tokens").alias("nb")).where("nb > 0")
    span = b.agg((F.min("nb") * threshold - 1e-9).alias("_low"), (F.max("nb") / threshold + 1e-9).alias("_high"))
    a = left.select(F.col(left_id).alias("a"), F.col("tokens").alias("ta"), F.size("tokens").alias("na")).where("na > 0")
    a = a.crossJoin(F.broadcast(span)).where("na BETWEEN _low AND _high").select("a", "na", F.explode("ta").alias("w"))
    frequency = b.select(F.explode("tb").alias("w")).groupBy("w").agg(F.count("*").alias("f"))

    def indexed(words: DataFrame, key: str, n: str) -> DataFrame:
        """(key, n, ws, w): the tokens of right in each set, and each of the rarest."""
        held = words.join(frequency, "w").groupBy(key, n).agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("s"))
        keep = F.col(n) - F.ceil(F.lit(threshold) * F.col(n) - 1e-9).cast("int") + 1 - (F.col(n) - F.size("s"))
        held = held.withColumn("k", keep).where("k > 0")
        return held.select(key, n, F.col("s.w").alias(f"ws_{key}"), F.explode(F.slice("s.w", 1, F.col("k"))).alias("w"))

    both = indexed(a, "a", "na").join(indexed(b.select("b", "nb", F.explode("tb").alias("w")), "b", "nb"), "w")
    common = F.size(F.array_intersect("ws_a", "ws_b"))
    found = both.select("a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold).distinct()
    return found.select(F.col("a").alias(left_id), F.col("b").alias(right_id), "jaccard")


def audit(corpus: DataFrame, disposable: DataFrame, left_id: str = "doc_id", right_id: str = "item_id", open_j: float = 0.70, open_content: float = 0.55) -> DataFrame:
    """(left_id, right_id, rule, jaccard, content_jaccard): exact normalised text, or both token and content similarity."""
    texts = lambda df, key: df.select(key, "text", norm_exact(F.col("text")).alias("norm"), tokens(F.col("text")).alias("tokens"))
    a, b = texts(corpus, left_id), texts(disposable, right_id)
    exact = a.where("norm <> ''").select(left_id, "norm").join(b.select(right_id, "norm"), "norm").select(left_id, right_id, F.lit("exact").alias("rule"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("content_jaccard"))
    near = jaccard_pairs(a, b, left_id, right_id, open_j)
    words = near.join(a.select(left_id, F.col("text").alias("ta")), left_id).join(b.select(right_id, F.col("text").alias("tb")), right_id)
    ca, cb = content_tokens(F.col("ta")), content_tokens(F.col("tb"))
    content = F.coalesce(F.try_divide(F.size(F.array_intersect(ca, cb)), F.size(F.array_union(ca, cb))), F.lit(0.0))
    near = words.select(left_id, right_id, F.lit("open").alias("rule"), "jaccard", content.alias("content_jaccard")).where(F.col("content_jaccard") >= open_content)
    return exact.union(near.join(exact, [left_id, right_id], "left_anti"))


def best_pair(corpus: DataFrame, disposable: DataFrame, left_id: str, right_id: str, thresholds: tuple[float, ...] = (0.8, 0.5, 0.3, 0.1)) -> DataFrame:
    """The most similar pair of all, the first by ids on ties. Pairs that share no token have similarity 0.

    Thresholds are tried from the highest: a pair over one of them is over all that follow. Only where no pair reaches the last
    are all shared tokens counted.
    """
    order = [F.desc("jaccard"), left_id, right_id]
    for t in thresholds:
        best = jaccard_pairs(corpus, disposable, left_id, right_id, t).orderBy(*order).limit(1).collect()
        if best:
            return corpus.sparkSession.createDataFrame(best, f"{left_id} {corpus.schema[left_id].dataType.simpleString()}, {right_id} {disposable.schema[right_id].dataType.simpleString()}, jaccard double")
    index = lambda df, key: df.select(key, F.size("tokens").alias(f"n_{key}"), F.explode("tokens").alias("w"))
    shared = index(corpus, left_id).join(index(disposable, right_id), "w").groupBy(left_id, right_id, f"n_{left_id}", f"n_{right_id}").agg(F.count("*").alias("c"))
    j = F.col("c") / (F.col(f"n_{left_id}") + F.col(f"n_{right_id}") - F.col("c"))
    return shared.select(left_id, right_id, j.alias("jaccard")).orderBy(*order).limit(1)
