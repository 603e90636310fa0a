"""Batch scoring of token windows with a linear bag-of-token model."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.config import BOS, DAY_SEP, EOS, ID_SPACE, PAD
from vitalstrand.operators.windows import end_date
from vitalstrand.session import stage

KEYS = ("person_id", "end_date", "split")


def token_bags(sequences: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, tid, n): how often each token occurs in a window, padding left out.

    A window is exploded and counted inside one task before anything is shuffled, and its bag is bounded
    by the sequence length.
    """
    cols = [*KEYS, *keep]
    return (
        sequences.select(*cols, F.explode("input_ids").alias("tid"))
        .where(F.col("tid") != PAD)
        .groupBy(*cols, "tid")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def score_windows(sequences: DataFrame, weights: DataFrame, bias: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """logit = bias + mean token weight; a token without a weight counts as 0. The join follows the size of ``weights``."""
    cols = [*KEYS, *keep]
    return (
        sequences.select(*cols, F.explode("input_ids").alias("tid"))
        .where(F.col("tid") != PAD)
        .join(weights, "tid", "left")
        .groupBy(*cols)
        .agg(F.round(F.lit(bias) + F.avg(F.coalesce("weight", F.lit(0.0))), 9).alias("logit"))
    )


def score_spans(tokens: DataFrame, calendar: DataFrame, weights: DataFrame, bias: float, window_days: int) -> DataFrame:
    """Scores of whole windows from sums per person-day: (person_id, end_date, split, n_tokens, logit).

    Every token is weighed once. Sums run along a person's days, and a window's sum is the difference of the running
    sums at its two edges, so overlap costs two rows for a window instead of its tokens. Weights are taken to 12 decimal
    places, which keeps the differences exact. ``n_tokens`` is the length with marks before any cut; a window that is
    cut must be scored by its sequence. A person has one row per day and two per window, which bounds a partition.
    """
    exact = F.coalesce("weight", F.lit(0.0)).cast("decimal(24,12)") * F.col("n").cast("decimal(10,0)")
    days = (
        tokens.join(weights, "tid", "left")
        .groupBy("person_id", F.to_date("ts").alias("day"))
        .agg(F.sum("n").alias("n"), F.sum(exact).cast("decimal(38,12)").alias("w"))
        .withColumns({"days": F.lit(1).cast("long"), "edge": F.lit(0), "k": F.lit(None).cast("int")})
    )
    ends = calendar.select("person_id", "first_end", "stride", F.explode(F.sequence(F.lit(0), F.col("last_k"))).alias("k"))
    last = end_date()
    edges = ends.select("person_id", "k", F.explode(F.array(
        F.struct(last.alias("day"), F.lit(1).alias("edge")),
        F.struct(F.date_sub(last, window_days + 1).alias("day"), F.lit(-1).alias("edge")),
    )).alias("e")).select(
        "person_id", "e.day", F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,12)").alias("w"),
        F.lit(0).cast("long").alias("days"), "e.edge", "k",
    )
    # a day's own row comes before the edges on that day
    upto = Window.partitionBy("person_id").orderBy("day", F.abs("edge")).rowsBetween(Window.unboundedPreceding, 0)
    run = days.unionByName(edges).select("person_id", "k", "edge", *[F.sum(c).over(upto).alias(c) for c in ("n", "w", "days")])
    # a product would widen the decimal and cut its scale
    signed = lambda c: F.sum(F.when(F.col("edge") > 0, F.col(c)).otherwise(-F.col(c))).alias(c)
    spans = run.where("edge <> 0").groupBy("person_id", "k").agg(signed("n"), signed("w"), signed("days")).where("n > 0")
    marks = weights.agg(
        *[F.coalesce(F.sum(F.when(F.col("tid").isin(ids), F.col("weight"))), F.lit(0.0)).alias(name) for name, ids in (("outer", [BOS, EOS]), ("between", [DAY_SEP]))]
    )
    length = F.col("n") + F.col("days") + 1
    total = F.col("w").cast("double") + F.col("outer") + (F.col("days") - 1) * F.col("between")
    # the sums of the marks' weights are one row
    scored = spans.join(calendar, "person_id").join(F.broadcast(marks))
    return scored.select("person_id", end_date().alias("end_date"), "split", length.alias("n_tokens"), F.round(F.lit(bias) + total / length, 9).alias("logit"))


def contributions(sequences: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of each token in a window's logit: count * weight / length."""
    size = F.size(F.filter("input_ids", lambda t: t != PAD)).cast("long")
    bags = token_bags(sequences.withColumn("len", size), keep=("len",))
    return bags.join(weights, "tid").select(
        *KEYS, "tid", "n", F.round(F.col("n") * F.col("weight") / F.col("len"), 9).alias("contribution")
    )


def pooled_vectors(sequences: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Masked mean of token vectors per window. ``vectors`` is (tid, vec array<double>).

    Marks such as the day separator occur in every window, so the vectors go to the tokens and not the
    tokens to the vectors. One average per dimension keeps the shuffle at one row per window and task instead of one per
    dimension and token.
    """
    bags = token_bags(sequences)
    joined = bags.join(vectors, "tid")
    total = F.greatest(F.sum("n"), F.lit(1))
    means = F.array(*[F.sum(F.col("vec")[i] * F.col("n")) / total for i in range(dim)])
    return joined.groupBy(*KEYS).agg(means.alias("pooled"))


def fit_log_odds(sequences: DataFrame, label: str = "label", smoothing: float = 1.0) -> DataFrame:
    """Class-balanced token weights (tid, weight) of all training windows, for ``score_windows`` with bias 0.

    A weight is the log ratio of a token's smoothed shares of the positive and of the other windows' tokens, so
    neither class gains by its size. One combining aggregate per token; the sums of the classes are one row.
    """
    bags = token_bags(sequences.where(F.col("split") == "train"), keep=(label,))
    side = lambda y: F.sum(F.when((F.col(label) == 1) == F.lit(y), F.col("n")).otherwise(0))
    counts = stage(bags.groupBy("tid").agg(side(True).alias("pos"), side(False).alias("neg")), "token-odds")
    sums = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count(F.lit(1)).alias("kinds")).withColumn("_one", F.lit(1))
    share = lambda c: (F.col(c) + smoothing) / (F.col(f"all_{c}") + smoothing * F.col("kinds"))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(sums), "_one").select("tid", (F.log(share("pos")) - F.log(share("neg"))).alias("weight"))


def fit_risk(sequences: DataFrame, label: str = "label", max_iter: int = 20, reg: float = 0.01):
    """Baseline risk model on token counts of the training windows, positives weighted to balance.

    Returns a fitted pipeline that maps windows to ``probability``.
    """
    vocabulary = [str(i) for i in range(1, ID_SPACE)]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="features")
    train = as_words(sequences.where(F.col("split") == "train"))
    rate = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    positive = max(1.0, (1.0 - rate) / max(rate, 1e-6))
    weighted = train.withColumn("w", F.when(F.col(label) == 1, positive).otherwise(1.0))
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="w", maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[counter, model]).fit(weighted)


def as_words(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("words", F.col("input_ids").cast("array<string>"))


def learned_weights(model) -> DataFrame:
    """Coefficients of a fitted risk model as (tid, weight), one row per id in use."""
    from pyspark.sql import SparkSession

    lr = model.stages[-1]
    rows = [(i + 1, float(c)) for i, c in enumerate(lr.coefficients.toArray()) if c]
    return SparkSession.active().createDataFrame(rows, "tid INT, weight DOUBLE")
