"""Learning to rank and text classification: features, splits, models of Spark ML, closed forms and reports."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import settled

#: The presence features of the mail classifier ("credit" stands twice, as in its source list).
SPAM_WORDS = (
    "free win limited offer click here porn urgent act now online exclusive deal expire spam clearance shopper order earn cash extra money "
    "credit card low price virus malware ad subscibe sale medicine million join trial legal bonus luxury lose weight dollars lower interest "
    "rate no credit check visit website older"
).split()


# -- ranking ---------------------------------------------------------------------------------------------------------------


def features(runs: dict[str, DataFrame], judgements: DataFrame, universe: str) -> DataFrame:
    """(query_id, doc_id, one column per run, label): scores of judged documents and of those that one run retrieved.

    Missing scores and grades are 0. The runs are stacked and pivoted by one aggregation, not joined one by one.
    """
    rows = judgements.select("query_id", "doc_id", F.lit("label").alias("name"), F.col("grade").cast("double").alias("value"))
    for name, run in runs.items():
        rows = rows.unionByName(run.select("query_id", "doc_id", F.lit(name).alias("name"), F.col("score").cast("double").alias("value")))
    pick = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0))
    wanted = F.max(F.col("name").isin("label", universe).cast("int")).alias("wanted")
    wide = rows.groupBy("query_id", "doc_id").agg(*[pick(n).alias(n) for n in runs], pick("label").cast("int").alias("label"), wanted)
    return wide.where("wanted = 1").drop("wanted")


def joined_features(scores: DataFrame, judgements: DataFrame) -> DataFrame:
    """``scores`` (query_id, doc_id, one column per model) with label; judged documents without scores get zeros."""
    names = [c for c in scores.columns if c not in ("query_id", "doc_id")]
    rows = scores.join(judgements.select("query_id", "doc_id", F.col("grade").cast("int").alias("label")), ["query_id", "doc_id"], "full")
    return rows.select("query_id", "doc_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], F.coalesce("label", F.lit(0)).alias("label"))


def query_split(queries: DataFrame, n_test: int = 5, seed: str = "42") -> DataFrame:
    """(query_id, split): the ``n_test`` queries of smallest MD5 are "test"."""
    h = F.md5(F.concat(F.lit(seed), F.col("query_id").cast("string")).cast("binary"))
    w = Window.orderBy(h, "query_id")  # one row per query
    return queries.select("query_id").distinct().withColumn("split", F.when(F.row_number().over(w) <= n_test, "test").otherwise("train"))


def ols(train: DataFrame, names: list[str], label: str = "label"):
    """Ordinary least squares with intercept, by normal equations."""
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(train)
    return LinearRegression(featuresCol="x", labelCol=label, predictionCol="predicted", solver="normal", regParam=0.0).fit(rows)


def predict(model, rows: DataFrame, names: list[str]) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=names, outputCol="x").transform(rows)).drop("x")


def reranked(predicted: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, score) by predicted value."""
    w = Window.partitionBy("query_id").orderBy(F.desc("predicted"), "doc_id")
    return predicted.select("query_id", "doc_id", F.row_number().over(w).alias("rank"), F.col("predicted").alias("score"))


# -- classification --------------------------------------------------------------------------------------------------------


def word_features(tokenised: DataFrame, words: list[str] = SPAM_WORDS, counts: bool = False) -> DataFrame:
    """(doc_id, one column f_<word> per distinct word): presence (0/1) or, with ``counts``, frequency. Row by row."""
    distinct = list(dict.fromkeys(words))
    found = F.filter("tokens", lambda t: t.isin(*distinct))
    rows = tokenised.select("doc_id", found.alias("found"))
    value = (lambda w: F.size(F.filter("found", lambda t: t == w))) if counts else (lambda w: F.array_contains("found", w).cast("int"))
    return rows.select("doc_id", *[value(w).alias(f"f_{w}") for w in distinct])


def threshold(value: Column, at: float = 0.5) -> Column:
    return F.when(value > at, 1).otherwise(0)


def bayes_table(examples: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(label, term, log_prob, log_prior) of multinomial naive Bayes, from (label, tokens).

    log((count + s) / (all counts of the label + s x vocabulary)) for every label and term of the training examples.
    """
    counts = examples.select("label", F.explode("tokens").alias("term")).groupBy("label", "term").agg(F.count("*").alias("n"))
    priors = examples.groupBy("label").agg(F.count("*").alias("docs")).withColumn("log_prior", F.ln(F.col("docs") / F.sum("docs").over(Window.partitionBy())))  # one row per label
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    vocabulary = counts.select("term").distinct()
    size = F.broadcast(vocabulary.agg(F.count("*").alias("v")))  # one row
    per_label = F.broadcast(priors.join(totals, "label", "left"))  # one row per label
    grid = vocabulary.crossJoin(per_label).crossJoin(size).join(counts, ["label", "term"], "left")
    p = (F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("total", F.lit(0)) + smoothing * F.col("v"))
    return grid.select("label", "term", F.ln(p).alias("log_prob"), "log_prior")


def bayes_scores(table: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, score): log prior + sum of log probabilities of the known tokens, for each label."""
    priors = table.select("label", "log_prior").distinct()
    tf = rows.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    sums = tf.join(table, "term").groupBy(key, "label").agg(F.sum(F.col("tf") * F.col("log_prob")).alias("s"))
    grid = rows.select(key).distinct().crossJoin(F.broadcast(priors))  # one row per label
    return grid.join(sums, [key, "label"], "left").select(key, "label", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score"))


def bayes_labels(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, predicted): the label of the highest score; ties to the smaller label."""
    best = F.max(F.struct("score", (-F.col("label")).alias("l")))["l"]
    return scores.groupBy(key).agg((-best).cast("int").alias("predicted"))


def vectoriser(train: DataFrame, size: int | None = None, tokens: str = "tokens") -> CountVectorizerModel:
    """Counts of all words of the train tokens, or of the commonest ``size``; other rows are transformed with the same words."""
    if size is None:
        size = max(train.select(F.explode(tokens)).distinct().count(), 1)
    return CountVectorizer(inputCol=tokens, outputCol="x", vocabSize=size).fit(train)


def save_vectors(model: CountVectorizerModel, rows: DataFrame, path: str) -> None:
    """The vectoriser under ``path``/vectoriser and the rows' sparse vectors under ``path``/matrix."""
    model.write().overwrite().save(f"{path}/vectoriser")
    model.transform(rows).drop(model.getInputCol()).write.mode("overwrite").parquet(f"{path}/matrix")


def load_vectors(spark: SparkSession, path: str) -> tuple[CountVectorizerModel, DataFrame]:
    return CountVectorizerModel.load(f"{path}/vectoriser"), spark.read.parquet(f"{path}/matrix")


def classifier(kind: str, n_train: int):
    """A Spark ML classifier on column x: "bayes" (multinomial, smoothing 1), "tree" (Gini) or "logistic" (L2 with C = 1)."""
    own = {"featuresCol": "x", "labelCol": "label", "predictionCol": "predicted"}
    return {
        "bayes": lambda: NaiveBayes(modelType="multinomial", smoothing=1.0, **own),
        "tree": lambda: DecisionTreeClassifier(impurity="gini", maxDepth=30, seed=42, **own),
        "logistic": lambda: LogisticRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, **own),
    }[kind]()


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumn("x", array_to_vector(F.array(*[F.col(n).cast("double") for n in names])))


def probabilities(predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, probability of class 1, label, predicted)."""
    return predicted.select(F.col(key).alias("id"), vector_to_array("probability")[1].alias("probability"), "label", F.col("predicted").cast("int").alias("predicted"))


def coefficients(model, vocabulary: list[str], most: int = 10) -> list[tuple[str, float]]:
    """The ``most`` words of largest absolute weight of a fitted linear model."""
    weights = model.coefficients.toArray()
    order = sorted(range(len(vocabulary)), key=lambda i: (-abs(weights[i]), vocabulary[i]))
    return [(vocabulary[i], float(weights[i])) for i in order[:most]]


def classification_report(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then macro avg, weighted avg and accuracy (in precision).

    From (label, predicted); ratios without a denominator are 0. Only the confusion counts are shuffled.
    """
    counts = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    ends = counts.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(0).cast("long").alias("p"), F.col("n").alias("s"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("predicted").alias("c"), F.col("n").alias("p"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("h")))).alias("e"))
    per = ends.groupBy("e.c").agg(F.sum("e.p").alias("predicted"), F.sum("e.s").alias("support"), F.sum("e.h").alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    per = per.select(F.col("c").cast("string").alias("class"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support", "hits")
    macro = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), "*")
    weigh = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    weighted = per.agg(weigh("precision").alias("precision"), weigh("recall").alias("recall"), weigh("f1").alias("f1"), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), "*")
    accuracy = per.agg(ratio(F.sum("hits"), F.sum("support")).alias("precision"), F.lit(None).cast("double").alias("recall"), F.lit(None).cast("double").alias("f1"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("class"), "*")
    return per.drop("hits").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: auc, by rank sums with ties counted half.

    Rows are counted per distinct score first; the distinct scores are dealt by range, each range is summed on its own
    and gets the counts below it, so no task sorts all scores.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    per = settled(per.repartitionByRange("s").withColumn("bin", F.spark_partition_id()))  # ranges are sampled: read twice, they must agree
    below = per.groupBy("bin").agg(F.sum("neg").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    own = F.coalesce(F.sum("neg").over(Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = per.withColumn("own", own).join(F.broadcast(below.select("bin", "below")), "bin")
    sums = at.agg(F.sum(F.col("pos") * (F.col("below") + F.col("own") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))
