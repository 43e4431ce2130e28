"""A domain classifier over vectors: gold labels from tags, balanced logistic regression, abstention; calibrated where that helps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.calibration import decide


def gold(senses: DataFrame, fields: list[str]) -> DataFrame:
    """lemma_id, domain for each of a lemma's tags (array) that is a field."""
    own = F.array_distinct(F.array_intersect("tags", F.array(*[F.lit(f) for f in fields])))
    return senses.select("lemma_id", F.explode(own).alias("domain")).distinct()


def single_label(labels: DataFrame) -> DataFrame:
    """The lemmas with one domain only: those train."""
    return labels.groupBy("lemma_id").agg(F.min("domain").alias("domain"), F.count("*").alias("n")).where("n = 1").drop("n")


def split(rows: DataFrame, label: str, share: float, seed: int = 0) -> DataFrame:
    """rows with held_out: the same share of every class, by hash order."""
    place = F.percent_rank().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    return rows.withColumn("held_out", place < share)


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: every class has the same sum."""
    counts = rows.groupBy(label).agg(F.count("*").alias("class_n")).withColumn("weight", F.sum("class_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("class_n")))
    return rows.join(F.broadcast(counts.select(label, "weight")), label)  # a row for each class


def probabilities(train: DataFrame, rows: DataFrame, label: str, vector: str, c: float = 4.0) -> tuple[list[str], DataFrame]:
    """Class names and rows with p (array, in the names' order) of a multinomial fit on train(label, vector)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = balanced(train.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))), label)
    n = ready.count()
    fit = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="class", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="features", labelCol="class", weightCol="weight", family="multinomial", regParam=1 / (c * max(n, 1)), maxIter=60, probabilityCol="probability")]).fit(ready)
    names = list(fit.stages[0].labels)
    scored = fit.stages[1].transform(rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return names, scored.withColumn("p", vector_to_array("probability")).drop("features", "probability", "rawPrediction", "prediction")


def class_limits(scored: DataFrame, names: list[str], label: str, precision: float = 0.7, least: float = 0.3) -> dict[str, float]:
    """For each class the confidence from which on its predictions have the wanted precision; 1.01 if never. One row for each class comes back."""
    top = F.array_max("p")
    rows = scored.select(F.get(F.array(*[F.lit(x) for x in names]), F.array_position("p", top).cast("int") - 1).alias("cls"), top.alias("conf"), F.col(label).alias("truth"), "id")
    order = Window.partitionBy("cls").orderBy(F.desc("conf"), "id")
    run = rows.withColumn("n", F.row_number().over(order)).withColumn("right", F.avg((F.col("cls") == F.col("truth")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = {r["cls"]: r["conf"] for r in run.groupBy("cls").agg(F.max_by("conf", F.when(F.col("right") >= precision, F.col("n"))).alias("conf")).collect()}
    return {x: max(found[x], least) if found.get(x) is not None else 1.01 for x in names}


def calibrated(scored: DataFrame, names: list[str], label: str) -> Column:
    """p with each class's share mapped by an isotonic fit of its own outcome on scored, and scaled to sum 1 again."""
    from pyspark.ml.regression import IsotonicRegression

    steps = []
    for i, name in enumerate(names):
        points = scored.select((F.col(label) == name).cast("double").alias("label"), F.get("p", F.lit(i)).alias("features"), F.lit(1.0).alias("weight"))
        fit = IsotonicRegression(weightCol="weight").fit(points)
        xs, ys = list(fit.boundaries), list(fit.predictions)
        x, y = F.get("p", F.lit(i)), F.lit(float(ys[-1]))
        for j in range(len(xs) - 1, 0, -1):
            line = F.lit(float(ys[j - 1])) + (x - float(xs[j - 1])) * ((float(ys[j]) - float(ys[j - 1])) / max(float(xs[j]) - float(xs[j - 1]), 1e-12))
            y = F.when(x < float(xs[j]), line).otherwise(y)
        steps.append(F.when(x <= float(xs[0]), F.lit(float(ys[0]))).otherwise(y))
    fitted = F.array(*steps)
    total = F.aggregate(fitted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(fitted, lambda v: F.when(total > 0, v / total).otherwise(0.0))


def calibration_error(scored: DataFrame, names: list[str], label: str, p: Column, bins: int = 10) -> float:
    """The expected calibration error of the top class of p."""
    from lexmill.operators.calibration import reliability

    top = F.array_max(p)
    cls = F.get(F.array(*[F.lit(x) for x in names]), F.array_position(p, top).cast("int") - 1)
    row = reliability(scored.select(top.alias("conf"), (cls == F.col(label)).cast("int").alias("ok")), bins).head()
    return row["ece"] if row else 0.0


def classify(rows: DataFrame, label: str, vector: str, share: float = 0.2, margin: float = 0.1) -> DataFrame:
    """id, truth, held_out, predicted (null: abstains) and top_p of rows(id, label, vector).

    The isotonic fit, from one half of the held-out rows, is used if it lowers the calibration error
    on the other half.
    """
    parts = split(rows, label, share)
    names, scored = probabilities(parts.where(~F.col("held_out")), parts, label, vector)
    halves = scored.where("held_out").withColumn("half", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)))
    if halves.where("half = 0").head(1) and halves.where("half = 1").head(1):
        fitted, test = calibrated(halves.where("half = 0"), names, label), halves.where("half = 1")
        if calibration_error(test, names, label, fitted) < calibration_error(test, names, label, F.col("p")):
            scored = scored.withColumn("p", fitted)
    limits = class_limits(scored.where("held_out"), names, label)
    return scored.select("id", F.col(label).alias("truth"), "held_out", decide(F.col("p"), names, limits, margin).alias("predicted"), F.array_max("p").alias("top_p"))
