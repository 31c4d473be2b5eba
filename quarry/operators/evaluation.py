"""Evaluation of ranked runs against graded judgements, by windows over each query's ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 20, 50, 100)
CLASSIC_CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
LEVELS = tuple(i / 10 for i in range(11))


def judged_run(run: DataFrame, judgements: DataFrame, binary: bool = False, order: list[Column] | None = None, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank, grade, hits, gained, num_rel, precision, recall): the run with running counts.

    Sorted by score, ties to smaller ids unless ``order`` says otherwise; unjudged documents have grade 0. num_rel is the
    sum of grades, or with ``binary`` the number of relevant documents; hits counts grades above 0, gained sums grades.
    """
    by_rank = Window.partitionBy("query_id").orderBy(*(order or [F.desc("score"), F.col("doc_id")]))
    grade = F.col("grade") > 0 if binary else F.col("grade")
    total = judgements.groupBy("query_id").agg(F.sum(grade.cast("long")).alias("num_rel"))
    rows = run.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(by_rank))
    if most:
        rows = rows.where(F.col("rank") <= most)
    rows = rows.join(judgements.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hits", F.sum((F.col("grade") > 0).cast("long")).over(upto)).withColumn("gained", F.sum(F.col("grade").cast("long")).over(upto))
    rows = rows.join(total, "query_id", "left").withColumn("num_rel", F.coalesce("num_rel", F.lit(0)))
    recall = F.when(F.col("num_rel") > 0, F.col("hits") / F.col("num_rel")).otherwise(0.0)
    return rows.select("query_id", "doc_id", "rank", "grade", "hits", "gained", "num_rel", (F.col("hits") / F.col("rank")).alias("precision"), recall.alias("recall"))


def at_cutoffs(judged: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(query_id, cutoff, precision, recall, f1); a cutoff that a run does not reach gives no row."""
    p, r = F.col("precision"), F.col("recall")
    rows = judged.where(F.col("rank").isin(*cutoffs))
    return rows.select("query_id", F.col("rank").alias("cutoff"), p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def summary(judged: DataFrame, judgements: DataFrame) -> DataFrame:
    """(query_id, average_precision, r_precision, ndcg). Queries without relevant judgements score 0.

    Precision is averaged over num_rel. R-precision is that at rank num_rel, or hits / num_rel for shorter runs. The gain
    is 2^grade - 1 over log2(rank + 1); a run's first num_rel ranks are set against all judgements, best first.
    """
    n, rank = F.col("num_rel"), F.col("rank")
    discounted = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    one = judged.groupBy("query_id", "num_rel").agg(
        F.coalesce(F.sum(F.when(F.col("grade") > 0, F.col("precision"))), F.lit(0.0)).alias("sum_precision"), F.max("hits").alias("hits"),
        F.max(F.when(rank == n, F.col("precision"))).alias("at_r"), F.coalesce(F.sum(F.when(rank <= n, discounted(F.col("grade"), rank))), F.lit(0.0)).alias("dcg"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = judgements.withColumn("r", F.row_number().over(best)).groupBy("query_id").agg(F.sum(discounted(F.col("grade"), F.col("r"))).alias("idcg"))
    rows = one.join(ideal, "query_id", "left")
    return rows.select(
        "query_id", F.when(n > 0, F.col("sum_precision") / n).otherwise(0.0).alias("average_precision"),
        F.when(n > 0, F.coalesce("at_r", F.col("hits") / n)).otherwise(0.0).alias("r_precision"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


def means(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """The mean of every measure, over the queries that have it."""
    measures = [c for c in rows.columns if c not in {"query_id", *by}]
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in measures])


def relevant_counts(judgements: DataFrame) -> DataFrame:
    """(query_id, relevant): judged documents of grade above 0."""
    return judgements.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("relevant"))


def curve(judged: DataFrame) -> DataFrame:
    """(query_id, rank, recall, precision): points of the precision-recall curve."""
    return judged.select("query_id", "rank", "recall", "precision")


def classic(run: DataFrame, judgements: DataFrame, cutoffs: tuple[int, ...] = CLASSIC_CUTOFFS, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Per topic with relevant judgements: num_ret, num_rel, rel_ret, avg_prec, r_prec, p_<cutoff>, ip_<level x 10>.

    Ties in score go to larger ids; at most 1000 documents count. Grades are summed: average precision adds
    grade x (1 + sum before) / rank. Cutoffs beyond the run divide what was found by the cutoff. R-precision of a topic
    with more relevant than retrieved is found / relevant. Interpolated precision at a level is the best precision at
    or after the first rank of that recall, 0 if it is never reached.
    """
    rows = judged_run(run, judgements, order=[F.desc("score"), F.desc("doc_id")], most=1000)
    before = F.col("gained") - F.col("grade")
    rows = rows.where("num_rel > 0").withColumn("prec", F.col("gained") / F.col("rank")).withColumn("rec", F.col("gained") / F.col("num_rel"))
    after = Window.partitionBy("query_id").orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("best", F.max("prec").over(after))
    n, rank = F.col("num_rel"), F.col("rank")
    totals = rows.groupBy("query_id", "num_rel").agg(
        F.count("*").alias("num_ret"), F.max("gained").alias("rel_ret"),
        F.sum(F.when(F.col("grade") > 0, F.col("grade") * (1 + before) / rank).otherwise(0.0)).alias("sum_prec"), F.max(F.when(rank == n, F.col("prec"))).alias("at_r"),
        *[F.max(F.when(rank <= k, F.col("gained"))).alias(f"g_{k}") for k in cutoffs],
        *[F.coalesce(F.max(F.when(F.col("rec") >= x, F.col("best"))), F.lit(0.0)).alias(f"ip_{round(x * 10)}") for x in levels],
    )
    r = F.when(n > F.col("num_ret"), F.col("rel_ret") / n).otherwise(F.col("at_r"))
    return totals.select(
        "query_id", "num_ret", "num_rel", "rel_ret", (F.col("sum_prec") / n).alias("avg_prec"), r.alias("r_prec"),
        *[(F.col(f"g_{k}") / k).alias(f"p_{k}") for k in cutoffs], *[f"ip_{round(x * 10)}" for x in levels],
    )


def classic_summary(topics: DataFrame) -> DataFrame:
    """One row: number of topics, totals of counts, means of measures."""
    counts = ("num_ret", "num_rel", "rel_ret")
    measures = [c for c in topics.columns if c not in {"query_id", *counts}]
    return topics.agg(F.count("*").alias("topics"), *[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in measures])
