"""Problem 9: a mixture in which each source holds its target share of all tokens.

Every document has a fixed hash. A source takes whole copies of all its documents as far as they fit, and one more
copy of those whose hash is below a threshold. The threshold comes from nested histograms: tokens by source and
leading bits of the hash, the bucket in which the target falls, then the next bits inside that bucket alone. So
nothing is sorted, no group is collected, and the final pass is a filter. Token counts are the only costly step;
they go through one exchange, spread by document, that every level and the final pass read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.encode import TOKENIZER, count_tokens
from panelspark.plans.lineage import shared

BITS, LEVELS = 12, 4  # 4,096 buckets a level; 48 bits tell apart the documents of any corpus in practice


def mix_sources(
    docs: DataFrame,
    sources: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, report)``.

    ``documents``: ``doc_id, source, n_tokens, copies`` of each document of a listed source that is taken at least once.
    ``report``: one row per listed source: ``source, target_share, max_repeats, n_docs, source_tokens, target_tokens,
    used_tokens, reached_share, short``. The budget is the tokens of all documents of listed sources, each counted
    once; ``target_tokens`` is its share of the budget. ``short`` sources stay below it even at ``max_repeats`` copies
    of everything, which is what they then contribute; others come within half a document of it. ``reached_share`` is
    of the tokens used.

    * documents of a null or unlisted source take no part; null and empty texts have 0 tokens and are never needed;
    * a listed source without documents is reported with zeros; a null share counts as 0, null repeats as 1;
    * of several rows for a source the first by share and repeats counts; rows with a null source are ignored;
    * repeated rows are documents of their own, but rows with one id share one hash: they get the same copies;
    * empty tables give empty results; other columns are ignored, whatever their names.
    """
    listed = sources.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(
        F.min(F.struct(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(1)).alias("repeats"))).alias("s")
    ).select("source", "s.share", F.greatest("s.repeats", F.lit(0)).alias("repeats"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = count_tokens(rows.join(listed.select("source"), "source", "left_semi"), ["doc_id", "source"], tokenizer=tokenizer)
    counted = shared(counted, "doc_id").select("doc_id", "source", "n_tokens")
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mixture")), 64 - BITS * LEVELS)
    counted = counted.select("doc_id", "source", "n_tokens", h.alias("h"))

    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs"))
    plan = listed.join(sizes, "source", "left").na.fill(0, ["size", "docs"])
    plan = plan.withColumn("budget", sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).scalar())
    plan = plan.withColumn("target", F.col("share") * F.col("budget")).withColumn("short", F.col("size") * F.col("repeats") < F.col("target"))
    whole = F.when(F.col("short"), F.col("repeats")).otherwise(F.coalesce(F.floor(F.try_divide("target", "size")), F.lit(0)))
    plan = plan.withColumn("whole", whole.cast("bigint")).withColumn("rest", F.when(F.col("short"), 0.0).otherwise(F.col("target") - F.col("whole") * F.col("size")))

    # nested thresholds: prefix is the boundary bucket so far, rest what is still wanted inside it
    limit = plan.select("source", F.lit(0).cast("bigint").alias("prefix"), "rest", F.lit(0).cast("bigint").alias("t"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = counted.join(limit.select("source", "prefix", "rest"), "source").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        buckets = inside.groupBy("source", "rest", F.shiftright("h", shift).alias("b")).agg(F.sum("n_tokens").alias("t"))
        w = Window.partitionBy("source").orderBy("b")  # at most 4,096 rows a source
        buckets = buckets.withColumn("upto", F.sum("t").over(w))
        # the first bucket that reaches beyond the rest; none if all of it fits
        edge = buckets.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("b", "t", "upto", "rest")).alias("e"))
        limit = edge.select("source", F.col("e.b").alias("prefix"), (F.col("e.rest") - (F.col("e.upto") - F.col("e.t"))).alias("rest"), F.col("e.t").alias("t"))
    # the last bucket, in practice one document, is taken if that comes nearer to the target
    limit = limit.select("source", F.when(F.col("t") - F.col("rest") < F.col("rest"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    plan = plan.join(limit, "source", "left")
    some = F.when(F.col("rest") > 0, F.col("below"))
    taken = counted.join(plan.select("source", "whole", some.alias("below"), "repeats"), "source")
    copies = F.least(F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0), F.col("repeats"))
    taken = taken.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")
    used = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    report = plan.join(used, "source", "left").na.fill(0, ["used_tokens"])
    report = report.withColumn("all_used", used.agg(F.sum("used_tokens").alias("all_used")).scalar())
    report = report.select(
        "source", F.col("share").alias("target_share"), F.col("repeats").cast("int").alias("max_repeats"), F.col("docs").alias("n_docs"), F.col("size").alias("source_tokens"),
        F.col("target").alias("target_tokens"), "used_tokens", F.try_divide("used_tokens", "all_used").alias("reached_share"), "short",
    )
    return taken, report
