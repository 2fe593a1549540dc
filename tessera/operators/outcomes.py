"""Analytics of the outcome log: asks joined to their feedback, terms of good and bad outcomes, small classifiers and their measures."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import month_name, month_of
from tessera.functions.text import content_tokens, coverage, pieces, stems
from tessera.functions.vectors import dot, norm
from tessera.operators.moments import element_sums
from tessera.storage import cut

#: Labels of feedback that something was wrong.
BAD_LABELS = ("missing_source", "stale", "wrong", "wrong_domain")


def linked(asks: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback with the ask it names; accept is false where there is none."""
    a = asks.select(F.col("operation_id").alias("linked_operation_id"), F.col("query").alias("asked"), "confidence", "conflict", F.lit(True).alias("there"))
    return feedback.join(a, "linked_operation_id", "left").withColumn("accept", F.coalesce("there", F.lit(False))).drop("there")


def packets(asks: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row per ask with the number and mean rating of its feedback, its labels with their counts, and the time from it to the first. Feedback is added up per ask before it is joined, so an ask with much of it is no hot spot."""
    per_label = feedback.where("linked_operation_id is not null").groupBy("linked_operation_id", "label").agg(F.count("*").alias("n"), F.sum("rating").alias("total"), F.count("rating").alias("rated"), F.min("at").alias("first"))
    labels = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("label", F.lit("none")), F.col("n").cast("string")))), ",")
    per = per_label.groupBy("linked_operation_id").agg(F.sum("n").alias("feedback"), F.round(F.try_divide(F.sum("total"), F.sum("rated")), 6).alias("mean_rating"), labels.alias("labels"), F.min("first").alias("first"))
    rows = asks.select("operation_id", "at", "confidence").join(per.withColumnRenamed("linked_operation_id", "operation_id"), "operation_id", "left")
    return rows.select("operation_id", "confidence", F.coalesce("feedback", F.lit(0)).alias("feedback"), "mean_rating", "labels", (F.col("first") - F.col("at")).alias("micros_to_first"))


def term_counts(feedback: DataFrame, min_support: int = 3) -> DataFrame:
    """Terms of the queries that got bad feedback: events, distinct queries, labels, and the share of the term's events that are bad; terms with at least min_support bad events."""
    bad = F.col("label").isin(*BAD_LABELS)
    rows = feedback.where("query is not null and label is not null").select("label", "query", bad.alias("bad"), F.explode(content_tokens("query")).alias("term"))
    out = rows.groupBy("term").agg(F.count_if("bad").alias("bad"), F.count("*").alias("events"), F.count_distinct(F.when(F.col("bad"), F.col("query"))).alias("queries"), F.count_distinct(F.when(F.col("bad"), F.col("label"))).alias("labels"))
    return out.where(F.col("bad") >= min_support).withColumn("bad_share", F.round(F.col("bad") / F.col("events"), 6))


def frequent_terms(rows: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """The n terms of each key's texts that are in the most of them."""
    words = rows.where(F.col(key).isNotNull()).select(key, F.explode(content_tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return words.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= n)


def readiness(feedback: DataFrame, support: int = 3, queries: int = 2) -> DataFrame:
    """Per label and scope its events, distinct queries and months, and whether these are enough to act on: ready, hold (some are) or reject."""
    rows = feedback.where("label is not null").groupBy("label", "scope").agg(F.count("*").alias("events"), F.count_distinct("query").alias("queries"), F.count_distinct(month_of("at")).alias("months"))
    enough = (F.col("events") >= support) & (F.col("queries") >= queries)
    return rows.withColumn("verdict", F.when(enough & (F.col("months") >= 2), "ready").when(enough, "hold").otherwise("reject"))


def monthly_labels(feedback: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Events per month, a column for each label."""
    rows = feedback.withColumn("month", month_name(month_of("at")))
    return rows.groupBy("month").pivot("label", list(labels)).count().na.fill(0)


def running_rating(feedback: DataFrame) -> DataFrame:
    """Per feedback on a memory the number and mean of the ratings up to it.

    Ratings are added up per memory and day; the days before are one small sum per memory and day, and only a day's own ratings are sorted, so a memory with much feedback is spread over its days.
    """
    rows = feedback.where("memory_id is not null and rating is not null and at is not null").withColumn("day", F.floor(F.col("at") / F.lit(86_400_000_000)))
    days = rows.groupBy("memory_id", "day").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))
    before = Window.partitionBy("memory_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("memory_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("total"))
    upto = Window.partitionBy("memory_id", "day").orderBy("at", "operation_id").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("operation_id", "memory_id", "day", F.count("*").over(upto).alias("k"), F.sum("rating").over(upto).alias("sum"))
    so_far = F.col("n") + F.col("k")
    return own.join(days, ["memory_id", "day"]).select("operation_id", "memory_id", so_far.alias("so_far"), F.round((F.col("total") + F.col("sum")) / so_far, 6).alias("mean_so_far"))


def threshold_sweep(rows: DataFrame, score: str, positive: str, steps: int = 10) -> DataFrame:
    """Confusion counts, precision and recall at thresholds 0, 1 / steps ... 1 of a score in 0..1, from one pass: rows are counted per step and summed up from above."""
    at = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor(F.round(F.col(score) * steps, 9)))).cast("int")
    have = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(at.alias("step")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    every = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    full = every.join(have, "step", "left").na.fill(0)
    above, all_ = Window.orderBy(F.desc("step")), Window.partitionBy(F.lit(0))
    tp, fp = F.sum("p").over(above), F.sum("n").over(above)
    out = full.select((F.col("step") / steps).alias("threshold"), tp.alias("true_positives"), fp.alias("false_positives"), (F.sum("p").over(all_) - tp).alias("false_negatives"), (F.sum("n").over(all_) - fp).alias("true_negatives"))
    return out.withColumns({"precision": F.round(F.try_divide("true_positives", F.col("true_positives") + F.col("false_positives")), 6), "recall": F.round(F.try_divide("true_positives", F.col("true_positives") + F.col("false_negatives")), 6)})


def two_thresholds(rows: DataFrame, first: str, second: str, positive: str, steps: int = 10) -> DataFrame:
    """passed and passed_positive, the rows with both scores (0..1) at or above each pair of thresholds 0, 1 / steps ... 1: first_threshold, second_threshold. Rows are counted per pair of steps and these few counts summed up along both; rows with a null count nowhere."""
    at = lambda c: F.least(F.lit(steps), F.greatest(F.lit(0), F.floor(F.round(F.col(c) * steps, 9)))).cast("int")
    have = rows.dropna(subset=[first, second, positive]).groupBy(at(first).alias("a"), at(second).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("p"))
    k = steps + 1
    grid = rows.sparkSession.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("a"), (F.col("id") % k).cast("int").alias("b")).join(have, ["a", "b"], "left").na.fill(0)
    for one, other in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(one).orderBy(F.desc(other))
        grid = grid.withColumns({c: F.sum(c).over(w) for c in ("n", "p")})
    return grid.select((F.col("a") / steps).alias("first_threshold"), (F.col("b") / steps).alias("second_threshold"), F.col("n").alias("passed"), F.col("p").alias("passed_positive"))


def best_pieces(uses: DataFrame, memories: DataFrame) -> DataFrame:
    """operation_id, memory_id, piece and score of the sentence among an ask's results that has most of the words of its query: the number of common stems and the part of the query's, then the better rank, the earlier sentence. Asks whose results have no text, or whose queries are null, are left out.

    Sentences are scored where their row lies and one per ask leaves each task.
    """
    asked = uses.where("query is not null").join(memories.select(F.col("id").alias("memory_id"), "text"), "memory_id")
    each = asked.withColumn("q", stems("query")).select("operation_id", "memory_id", "rank", "q", F.posexplode(pieces("text")).alias("at", "piece"))
    there = stems("piece")
    score = F.round(F.size(F.array_intersect("q", there)) + coverage(F.col("q"), there), 6)
    best = F.min(F.struct((-score).alias("s"), F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), "memory_id", "at", "piece")).alias("b")
    return each.groupBy("operation_id").agg(best).select("operation_id", "b.memory_id", "b.piece", (-F.col("b.s")).alias("score"))


def source_scores(uses: DataFrame, feedback: DataFrame, sources: DataFrame) -> DataFrame:
    """operation_id, expected and present of each ask with good feedback (a rating above 0) on memories with a source: these sources, and those of them that the ask's results have."""
    of = sources.where("source is not null").select(F.col("id").alias("memory_id"), "source")
    good = feedback.where("rating > 0 and memory_id is not null").select(F.col("linked_operation_id").alias("operation_id"), "memory_id").join(of, "memory_id").select("operation_id", "source").distinct()
    have = uses.join(of, "memory_id").select("operation_id", "source").distinct().withColumn("there", F.lit(True))
    return good.where("operation_id is not null").join(have, ["operation_id", "source"], "left").groupBy("operation_id").agg(F.count("*").alias("expected"), F.count("there").alias("present"))


def _fold(key: str, folds: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds))


def _for_other_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Each row, which stands for a fold, once for each of the other folds."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")), lambda f: f != F.col("fold"))
    return rows.withColumn("fold", F.explode(others))


def naive_bayes(samples: DataFrame, folds: int = 5) -> DataFrame:
    """Multinomial naive Bayes with Laplace smoothing, each sample predicted by what the samples of the other folds give: id, label, predicted.

    samples: id, label, terms (a set). Folds go by a hash of the id. Counts are added up per fold, label and term and only then passed on to the other folds; likelihoods are joins and sums. A null label is left out, and so is a term that no sample of the other folds has; a tie goes to the label that comes first. Labels of all folds are sent to every task if there are at most 10,000 rows of them, and joined else.
    """
    rows = samples.where("label is not null").withColumn("fold", _fold("id", folds))
    words = rows.select("id", "fold", "label", F.explode("terms").alias("term"))
    own = words.groupBy("fold", "label", "term").agg(F.count("*").alias("n"))
    counts = cut(_for_other_folds(own, folds).groupBy("fold", "label", "term").agg(F.sum("n").alias("n")), "terms")
    vocabulary = counts.select("fold", "term").distinct()
    labels = _for_other_folds(rows.groupBy("fold", "label").agg(F.count("*").alias("docs")), folds).groupBy("fold", "label").agg(F.sum("docs").alias("docs"))
    labels = labels.join(counts.groupBy("fold", "label").agg(F.sum("n").alias("terms")), ["fold", "label"], "left").join(vocabulary.groupBy("fold").agg(F.count("*").alias("v")), "fold", "left").na.fill(0)
    labels = cut(labels.withColumn("prior", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy("fold")))), "labels")
    model = F.broadcast(labels) if labels.count() <= 10_000 else labels
    least = F.log(1 / (F.col("terms") + F.col("v")))
    heard = words.drop("label").join(vocabulary, ["fold", "term"], "left_semi")
    gain = heard.join(counts, ["fold", "term"]).join(model, ["fold", "label"]).groupBy("id", "label").agg(F.sum(F.log((F.col("n") + 1) / (F.col("terms") + F.col("v"))) - least).alias("gain"))
    n_words = heard.groupBy("id").agg(F.count("*").alias("words"))
    base = rows.select("id", "fold", F.col("label").alias("actual")).join(n_words, "id", "left").na.fill(0, ["words"]).join(model, "fold")
    score = F.round(F.col("prior") + F.coalesce("gain", F.lit(0.0)) + F.when(F.col("words") > 0, F.col("words") * least).otherwise(F.lit(0.0)), 6)
    best = F.min(F.struct((-score).alias("s"), F.col("label").alias("predicted")))
    return base.join(gain, ["id", "label"], "left").groupBy("id", F.col("actual").alias("label")).agg(best.alias("b")).select("id", "label", "b.predicted")


def softmax(vectors: DataFrame, folds: int = 5, l2: float = 0.001, rounds: int = 100) -> DataFrame:
    """Each vector's label and what a softmax model of the other folds takes it for: vec_id, label, predicted (as a string).

    vectors: vec_id, label, embedding. A fold's model is trained by Spark's own multinomial regression, whose gradients are summed up where the rows lie. Null labels, null or incomplete vectors, and those of another length than the most frequent one (the shorter of two) are left out; where the other folds have no rows, nothing is predicted (null).
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & (F.size("embedding") > 0)
    rows = vectors.where("label is not null").where(whole)
    common = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, label string, predicted string"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    x = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    rows = cut(rows.where(F.size("embedding") == common["size"]).select("vec_id", F.col("label").cast("string").alias("label"), "embedding", _fold("vec_id", folds).alias("fold")), "samples")
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    names = F.array(*[F.lit(n) for n in index.labels])
    shaped, per_fold = index.transform(rows.withColumn("x", x)), {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    parts = []
    for fold in sorted(per_fold):
        own = shaped.where(F.col("fold") == fold)
        if len(per_fold) == 1:
            parts.append(own.select("vec_id", "label", F.lit(None).cast("string").alias("predicted")))
            continue
        model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=l2, maxIter=rounds).fit(shaped.where(F.col("fold") != fold))
        parts.append(model.transform(own).select("vec_id", "label", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted")))
    return reduce(DataFrame.unionByName, parts)


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows per label and prediction."""
    return predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def nearest_centroid(vectors: DataFrame, folds: int = 5) -> DataFrame:
    """Each vector's label and the label of the nearest mean vector of the other folds' labels, by cosine: vec_id, label, predicted, margin (cosine of the best less that of the second).

    vectors: vec_id, label, embedding. Sums are formed per fold, label and element; a fold's means add up those of the others. The means are one row per label and fold; they are joined to the vectors of a fold as one array, whose size is the number of labels.
    """
    rows = vectors.where("label is not null").withColumn("fold", _fold("vec_id", folds))
    # a sum goes to each of the other folds, as wide as the small model
    sums = element_sums(rows, ["fold", "label"], "embedding")
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")), lambda f: f != F.col("fold")))
    sums = sums.select(others.alias("fold"), "label", "i", "x", "n")
    means = sums.groupBy("fold", "label", "i").agg(F.try_divide(F.sum("x"), F.sum("n")).alias("x")).groupBy("fold", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    model = means.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("model"))
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    scores = F.transform("model", lambda m: F.struct((-F.round(dot(e, m["mean"]) / (norm(e) * norm(m["mean"])), 6)).alias("s"), m["label"].alias("label")))
    ranked = rows.join(model, "fold").select("vec_id", "label", F.array_sort(scores).alias("r"))
    return ranked.select("vec_id", "label", F.col("r")[0]["label"].alias("predicted"), F.round(F.col("r")[1]["s"] - F.col("r")[0]["s"], 6).alias("margin"))


def leave_one_out(vectors: DataFrame) -> DataFrame:
    """vec_id, label and predicted: the label whose vectors' sum, the vector itself left out, is nearest by cosine; ties go to the label that comes first, a label without other vectors comes last.

    The sums are one row per label; all of them are joined to each vector as one array, whose size is the number of labels.
    """
    rows = vectors.where("label is not null")
    sums = element_sums(rows, ["label"], "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    model = sums.agg(F.array_sort(F.collect_list(F.struct("label", "total"))).alias("model")).select(F.lit(1).alias("one"), "model")
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rest = lambda m: F.when(m["label"] == F.col("label"), F.zip_with(m["total"], e, lambda t, x: t - x)).otherwise(m["total"])
    far = lambda m: F.coalesce(-F.round(F.try_divide(dot(e, rest(m)), norm(e) * norm(rest(m))), 6), F.lit(float("inf")))
    scores = F.transform("model", lambda m: F.struct(far(m).alias("s"), m["label"].alias("label")))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(model), "one").select("vec_id", "label", F.array_min(scores)["label"].alias("predicted"))


def logistic(samples: DataFrame, label: str, features: list[str], l2: float = 0.001, rounds: int = 25, epsilon: float = 1e-9) -> DataFrame:
    """feature (``intercept`` and features), mean, scale and weight of a logistic model of label (boolean) on the standardised features, with l2 times half the square of the weights added to the mean loss.

    Samples with a null or NaN are left out; a feature without spread has scale 1. Each round is one aggregation, the gradient and the second derivatives summed up where the rows lie; the driver gets these sums, a small matrix, and solves for the next weights until they stand still. Without samples, or with one label only, the weights are those at which the penalty holds them; no samples at all give no rows.
    """
    spark = samples.sparkSession
    good = [F.col(f).isNotNull() & ~F.isnan(f) for f in features]
    rows = samples.where(F.col(label).isNotNull()).where(reduce(and_, good)).select(F.col(label).cast("double").alias("y"), *(F.col(f).cast("double") for f in features))
    rows = cut(rows, "samples")
    first = rows.agg(F.count("*").alias("n"), *(F.avg(f) for f in features), *(F.stddev_pop(f) for f in features)).first()
    n, k = first[0], len(features)
    schema = "feature string, mean double, scale double, weight double"
    if not n:
        return spark.createDataFrame([], schema)
    means, scales = list(first[1 : 1 + k]), [s or 1.0 for s in first[1 + k :]]
    x = [F.lit(1.0), *((F.col(f) - m) / s for f, m, s in zip(features, means, scales, strict=True))]
    w = np.zeros(k + 1)
    keep = np.diag([0.0] + [l2] * k)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-reduce(add, (float(a) * c for a, c in zip(w, x, strict=True)))))
        v = rows.select((F.col("y") - p).alias("r"), (p * (1 - p)).alias("v"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        sums = np.array(v.agg(*(F.sum(F.col("r") * F.col(f"x{i}")) for i in range(k + 1)), *(F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs)).first(), float) / n
        second = keep + 1e-9 * np.eye(k + 1)
        for (i, j), s in zip(pairs, sums[k + 1 :], strict=True):
            second[i, j] += s
            second[j, i] = second[i, j]
        step = np.linalg.solve(second, sums[: k + 1] - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < epsilon:
            break
    out = zip(["intercept", *features], [0.0, *means], [1.0, *scales], w.tolist(), strict=True)
    return spark.createDataFrame([(f, float(m), float(s), round(float(a), 6)) for f, m, s, a in out], schema)
