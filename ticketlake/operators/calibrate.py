"""Calibration and linear heads.

A temperature is found by passes over all rows that narrow a bracket; isotonic curves by pooling
inside sorted ranges of scores, then pooling the pools of a class.  Both are applied as column
expressions, to rows that the fit has not seen as well.  Linear models come from ``pyspark.ml``.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.operators import term_blocks as tb
from ticketlake.operators.features import argmax_label, class_weights, softmax, stratified_kfold, vocabulary
from ticketlake.session import cut_lineage, stored

# The range of temperatures, what is added to a probability before its logarithm, and the
# sum from which calibrated probabilities are divided by it.
TEMPERATURES = (0.1, 10.0)
LOG_EPS = 1e-10
LEAST_SUM = 1e-9
# Points of one pass over a bracket, and passes: each leaves a tenth of the bracket's ratio.
GRID_POINTS = 21
PASSES = 5
ROUND = 9


def negative_log_likelihood(logits: Column, label: Column, temperature: Column) -> Column:
    """Loss of one row at a temperature; ``label`` counts from 0."""
    z = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(total) + top - F.element_at(z, (label + 1).cast("int"))


def to_logits(probs: Column) -> Column:
    """Logarithms of probabilities, the logits up to a constant."""
    return F.transform(probs, lambda p: F.log(p.cast("double") + F.lit(LOG_EPS)))


def fit_temperature(df: DataFrame, logits: str, label: str, bounds: tuple[float, float] = TEMPERATURES,
                    points: int = GRID_POINTS, passes: int = PASSES) -> DataFrame:
    """``(temperature, nll)``, one row: the temperature in ``bounds`` of least mean loss.

    The loss has one minimum in the temperature.  Each pass meets all rows with ``points`` temperatures
    of equal ratio, whose sums are all that is shuffled, and goes on between the neighbours of the best.
    A minimum outside the bounds gives the bound.  Rows without logits or label do not count; without
    any row the temperature is null.
    """
    rows = cut_lineage(df.select(F.col(logits).alias("_z"), F.col(label).alias("_y")).where("_z IS NOT NULL AND _y IS NOT NULL"))
    low, high = (math.log(x) for x in bounds)
    best = None
    for _ in range(passes):
        grid = [math.exp(low + (high - low) * i / (points - 1)) for i in range(points)]
        losses = rows.agg(*[F.avg(negative_log_likelihood(F.col("_z"), F.col("_y"), F.lit(t))).alias(f"l{i}")
                            for i, t in enumerate(grid)]).first()
        if losses[0] is None:
            break
        at = min(range(points), key=lambda i: (losses[i], i))
        best = (grid[at], losses[at])
        step = (high - low) / (points - 1)
        low, high = max(low, math.log(grid[at]) - step), min(high, math.log(grid[at]) + step)
    return df.sparkSession.createDataFrame([best or (None, None)], "temperature double, nll double")


def apply_temperature(logits: Column, temperature: Column) -> Column:
    """Softmax of the logits divided by the temperature."""
    return softmax(F.transform(logits, lambda x: x / temperature))


def scale_probabilities(probs: Column, temperature: Column) -> Column:
    """softmax of ``log(p + eps) / T``."""
    return apply_temperature(to_logits(probs), temperature)


def _pool(low: list, high: list, total: list, count: list) -> tuple[list, list, list, list]:
    """Pools neighbours while a mean is not above the one before; inputs in the order of scores."""
    out: list[list] = []
    for pool in zip(low, high, total, count, strict=True):
        out.append(list(pool))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, top, s, n = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = top, out[-1][2] + s, out[-1][3] + n
    return tuple(list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])


def fit_isotonic(df: DataFrame, probs: str, label: str) -> DataFrame:
    """``(class_no, xs, ys)``: for every class the best non-decreasing curve of "the label is this
    class" over its probability, as the corners of the curve in the order of scores.

    Rows with the same score are added up.  Each range of sorted scores pools its own neighbours, then
    the pools of a class are pooled; with whole outcomes their number grows with the two-thirds power of
    the rows at most, so a class fits in one task.  Rows without probabilities or label do not count.
    """
    import pyarrow as pa
    schema = "class_no int, low double, high double, s long, n long"
    fields = pa.schema([("class_no", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("s", pa.int64()), ("n", pa.int64())])
    points = (df.where(F.col(label).isNotNull()).select(F.col(label).alias("_y"), F.posexplode(probs).alias("class_no", "score"))
              .where("score IS NOT NULL").groupBy("class_no", "score")
              .agg(F.sum((F.col("_y") == F.col("class_no")).cast("long")).alias("s"), F.count("*").alias("n")))

    def pooled(number: int, low, high, s, n):
        low, high, s, n = _pool(low, high, s, n)
        return pa.RecordBatch.from_arrays([pa.array([number] * len(low), pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64()),
                                           pa.array(s, pa.int64()), pa.array(n, pa.int64())], schema=fields)

    def by_range(batches):
        # a batch's pools may go on in the next one: the second step joins them
        for b in batches:
            numbers = b.column(0).to_pylist()
            rows = [b.column(i).to_pylist() for i in range(1, 5)]
            for number in sorted(set(numbers)):
                at = [i for i, x in enumerate(numbers) if x == number]
                yield pooled(number, *[[c[i] for i in at] for c in rows])
    pools = (points.repartitionByRange("class_no", "score").sortWithinPartitions("class_no", "score")
             .select("class_no", F.col("score").alias("low"), F.col("score").alias("high"), "s", "n").mapInArrow(by_range, schema))

    def by_class(t: pa.Table) -> pa.Table:
        t = t.sort_by("low")
        number = t.column("class_no")[0].as_py()
        low, high, s, n = _pool(*[t.column(c).to_pylist() for c in ("low", "high", "s", "n")])
        xs, ys = [], []
        for a, z, total, count in zip(low, high, s, n, strict=True):
            ends = [a] if a == z else [a, z]
            xs += ends
            ys += [total / count] * len(ends)
        return pa.table({"class_no": pa.array([number], pa.int32()), "xs": pa.array([xs], pa.list_(pa.float64())),
                         "ys": pa.array([ys], pa.list_(pa.float64()))})
    return pools.groupBy("class_no").applyInArrow(by_class, "class_no int, xs array<double>, ys array<double>")


def on_curve(x: Column, xs: Column, ys: Column) -> Column:
    """The curve's value at x: binary search among its corners, linear between two, level beyond the ends."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(xs) + 1)).cast("int") + 1)

    def halve(at, _):
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = F.get(xs, middle) <= x
        return F.struct(F.when(right, middle).otherwise(at["low"]).alias("low"),
                        F.when(right, at["high"]).otherwise(middle).alias("high"))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(xs).alias("high")), halve, lambda at: at["low"])

    def value(at):
        x0, x1, y0, y1 = F.get(xs, at), F.get(xs, at + 1), F.get(ys, at), F.get(ys, at + 1)
        return (F.when(x <= F.get(xs, F.lit(0)), F.get(ys, F.lit(0))).when(x1.isNull(), y0)
                .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0)))
    # a lambda over a list of one keeps the search from being made for each use of its place
    return F.get(F.transform(F.array(place), value), F.lit(0))


def apply_isotonic(df: DataFrame, curves: DataFrame, probs: str, out_col: str = "calibrated") -> DataFrame:
    """each class's probability on its curve, divided by their sum where that is above 1e-9.

    Classes without a curve keep their probability.  The curves are a few arrays, attached as a scalar.
    """
    listed = curves.agg(F.map_from_entries(F.collect_list(F.struct("class_no", F.struct("xs", "ys")))).alias("_curves"))
    from ticketlake.operators.retrieval import attach_scalars
    rows = attach_scalars(df, listed)

    def one(p, i):
        def placed(curve):
            return F.when(curve.isNull() | p.isNull(), p.cast("double")).otherwise(on_curve(p, curve["xs"], curve["ys"]))
        return F.get(F.transform(F.array(F.element_at("_curves", i)), placed), F.lit(0))  # a class's curve is looked up once
    raw = F.transform(probs, one)
    total = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x)
    return (rows.withColumn("_raw", raw).withColumn(out_col, F.when(total > F.lit(LEAST_SUM), F.transform("_raw", lambda x: x / total))
                                                    .otherwise(F.col("_raw"))).drop("_raw", "_curves"))


# Terms of the classifier's two blocks, and the members of its ensemble.
WORD_FEATURES, CHAR_FEATURES = 20_000, 10_000
FOLDS = 5
# Training rows of a partition, about; rows from which members are fitted one by one, as each keeps its rows while it
# learns; and narrow rows that may be broadcast.
PART_ROWS, MANY_ROWS, BROADCAST_ROWS = 2_000, 20_000, 1_000_000


TERMS = (tb.word_grams, tb.char_grams)


def _vocabularies(train: DataFrame, text_col: str, sizes: tuple[int, int]) -> list[list]:
    """``(term, idf)`` of the most frequent word 1- and 2-grams, and of character 3- to 5-grams.  They are a part of
    the model and have at most ``sizes`` terms, which are counted exactly over all training rows."""
    n = train.sparkSession.range(1).select(F.lit(train.count()).cast("long").alias("n_docs"))
    return [[(r.term, r.idf) for r in vocabulary(tb.document_counts(train, grams(F.col(text_col))), n, 1, 1.0, size).collect()]
            for grams, size in zip(TERMS, sizes, strict=True)]


def _least_hashed(df: DataFrame, text_col: str, rows: int) -> DataFrame:
    """The rows whose text has the smallest hash (ties: smaller text).  Only hashes are sorted for the bound, so
    that no more texts than are kept meet in one task."""
    key = F.xxhash64(text_col)
    last = df.select(key.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(key <= last if last is not None else F.lit(False)).orderBy(key, text_col).limit(rows)


def _sparse(size: int):
    """Arrays of places and values as one ``pyspark.ml`` vector."""
    return F.udf(lambda at, values: Vectors.sparse(size, at, values), VectorUDT())


def _member_probs(models: list, widths: list[int], n_terms: int):
    """For ``with_known``: one array of probabilities a model; classes that a model lacks have none."""
    weights = [(np.ascontiguousarray(m.coefficientMatrix.toArray()[:, :n_terms]), m.interceptVector.toArray()) for m in models]

    def add(rows, row, number, weight):
        made = []
        for (w, b), width in zip(weights, widths, strict=True):
            z = np.stack([np.bincount(row, weights=weight * w[k][number], minlength=rows) + b[k] for k in range(len(b))], axis=1)
            top = z.max(axis=1, keepdims=True)
            with np.errstate(invalid="ignore"):
                e = np.where(np.isinf(top), z == top, np.exp(z - top))  # a model of one class has an infinite intercept
            p = np.zeros((rows, width))
            p[:, :len(b)] = e / e.sum(axis=1, keepdims=True)
            made.append(tb.lists(p.ravel(), np.full(rows, width)))
        return made
    return add


def fit_text_classifier(train: DataFrame, text_col: str, label_cols: list[str], sizes: tuple[int, int] = (WORD_FEATURES, CHAR_FEATURES),
                        folds: int = FOLDS, iterations: int = 50, at_once: int = 4):
    """for each label column an ensemble of calibrated logistic regressions over TF-IDF features.

    All rows with a label train.  The training rows of a label are dealt into stratified folds.  Each member learns on all folds but
    one, with balanced class weights and a ridge of 1 / rows; its isotonic curves, one a class, learn
    from its probabilities on the fold that it has not seen.  A row's probabilities are the mean of the
    members' calibrated ones.  Rows without a label do not train it.  Returns a function ``df -> df``
    that adds ``<label column>_label``, ``_confidence`` and ``_probs``.

    Terms are counted and looked up in blocks of rows, and the training rows are dealt to all cores, so
    that no step works in one task.
    """
    spark = train.sparkSession
    some = train.where(F.coalesce(*[F.col(c).cast("string") for c in label_cols]).isNotNull()).select(text_col, *label_cols)
    rows = some.count()
    some = stored(some.withColumn("_id", F.monotonically_increasing_id())
                  .repartition(max(spark.sparkContext.defaultParallelism, rows // PART_ROWS), "_id"))
    known = _vocabularies(some, text_col, sizes)
    n_terms = sum(map(len, known))
    axes = {c: [r[0] for r in some.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()] for c in label_cols}

    # folds, weights and numbers of labels go with the texts, so that vectors are not shuffled
    dealt = some.select("_id")
    for j, c in enumerate(label_cols):
        index = F.array_position(F.array(*[F.lit(x) for x in axes[c]]), F.col(c)) - 1 if axes[c] else F.lit(None)
        own = class_weights(stratified_kfold(some.where(F.col(c).isNotNull()).select("_id", c), c, "_id", folds), c)
        dealt = dealt.join(own.select("_id", F.col("fold").alias(f"_f{j}"), F.col("weight").alias(f"_w{j}"),
                                      index.cast("double").alias(f"_y{j}")), "_id", "left")
    dealt = cut_lineage(dealt)
    dealt = some.join(F.broadcast(dealt) if rows <= BROADCAST_ROWS else dealt, "_id")

    def entries(n, row, number, weight):
        count = np.bincount(row, minlength=n)
        return [tb.lists(number.astype(np.int32), count), tb.lists(weight, count)]
    fields = T.StructType().add("_at", T.ArrayType(T.IntegerType())).add("_values", T.ArrayType(T.DoubleType()))
    made = tb.with_known(dealt.drop(*label_cols), [g(F.col(text_col)) for g in TERMS], known, entries, fields)
    made = cut_lineage(made.withColumn("features", _sparse(max(1, n_terms))("_at", "_values")).drop(text_col, "_at", "_values"))
    counts = {j: {r[0]: r[1] for r in made.groupBy(f"_f{j}").count().collect() if r[0] is not None} for j in range(len(label_cols))}

    def member(job):
        j, f = job
        c, n = label_cols[j], sum(x for fold, x in counts[j].items() if fold != f)
        if not n or f not in counts[j]:  # fewer rows than folds
            return c, None, None
        learn, rest = made.where(F.col(f"_f{j}") != f), made.where(F.col(f"_f{j}") == f)
        model = LogisticRegression(labelCol=f"_y{j}", weightCol=f"_w{j}", maxIter=iterations, regParam=1.0 / n, standardization=False,
                                   family="multinomial").fit(learn.select("features", f"_w{j}", f"_y{j}"))
        unseen = model.transform(rest).select(_wide("probability", len(axes[c])).alias("probs"), F.col(f"_y{j}").cast("int").alias("y"))
        return c, model, cut_lineage(fit_isotonic(unseen, "probs", "y"))

    def _wide(col, k):
        p = vector_to_array(col)  # a member that lacks the last classes has fewer entries
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0)))
    jobs = [(j, f) for j, c in enumerate(label_cols) if axes[c] for f in range(folds)]
    with ThreadPoolExecutor(at_once if rows < MANY_ROWS else 1) as pool:
        members = [m for m in pool.map(member, jobs) if m[1] is not None]
    add = _member_probs([m for _, m, _ in members], [len(axes[c]) for c, _, _ in members], n_terms)

    def predict(df: DataFrame) -> DataFrame:
        columns, names = df.columns, [f"_p{i}" for i in range(len(members))]
        fields = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
        out = tb.with_known(df, [g(F.col(text_col)) for g in TERMS], known, add, fields) if members else df
        for c in label_cols:
            parts = []
            for name, (of, _, curves) in zip(names, members, strict=True):
                if of == c:
                    out = apply_isotonic(out, curves, name, f"{name}_cal").drop(name)
                    parts.append(f"{name}_cal")
            if parts:
                sums = F.array(*parts)
                mean = F.transform(F.sequence(F.lit(0), F.lit(len(axes[c]) - 1)), lambda i: F.aggregate(
                    sums, F.lit(0.0), lambda a, p: a + F.get(p, i)) / len(parts))
                out = out.withColumn(f"{c}_probs", mean).drop(*parts)
                label, conf = argmax_label(F.col(f"{c}_probs"), axes[c])
            else:  # nothing to learn from
                out = out.withColumn(f"{c}_probs", F.array().cast("array<double>"))
                label, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
            out = out.withColumn(f"{c}_label", label).withColumn(f"{c}_confidence", conf)
        return out.select(*columns, *[f"{c}_{x}" for c in label_cols for x in ("label", "confidence", "probs")])
    return predict


def linear_head(df: DataFrame, vec_col: str, weights: list[list[float]], bias: list[float]) -> Column:
    """logits of a linear layer over a vector column."""
    def logit(w, b):
        return F.aggregate(F.zip_with(vec_col, F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x.cast("double") * y),
                           F.lit(float(b)), lambda s, x: s + x)
    return F.array(*[logit(w, b) for w, b in zip(weights, bias, strict=True)])


def fit_linear_head(train: DataFrame, vec_col: str, label_col: str, iterations: int = 50) -> tuple[list, list]:
    """Weights and biases by logistic regression over the vectors; labels count from 0."""
    rows = train.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                        F.col(label_col).cast("double").alias("label"))
    m = LogisticRegression(maxIter=iterations, family="multinomial").fit(rows)
    return m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist()
