"""Embedding whitening over exactly centred rows.

Entries become whole numbers x = floor(scale * c) + shift. The fit list holds each
distinct x vector once: n vectors with sums S per dimension. n * x - S is exact, and its
quotient by n is the centred row, rounded once. MLlib's RowMatrix gives the Gramian of the
centred rows; by n it is the covariance, a matrix of the width of a vector, whose
eigenvectors are found locally and go to every worker.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, or
one too large for a whole number of 53 bits, are left out; so are vectors of another length
than most have (of equally frequent lengths the greater stays); repeated rows and vectors
give rows of their own, but count once in the fit; null ids stay; a component without
variance, by the precision of doubles, has null as `whitened` and doesn't count in
`identity_error`; `deviation` is null where it is past 64 bits; an empty table, or one
without a usable vector, gives no rows; ties of eigenvalues have any basis of their plane,
one for all rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import write_table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Below this, whole numbers and their sums stay within 64 bits.
_SAFE = float(1 << 61)


def _centred(x: pd.Series, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers where they fit, else Python's."""
    x = np.stack(x.to_numpy()).astype(np.int64)
    if n * max(1, int(np.abs(x).max())) < _SAFE:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _squares(centred: np.ndarray) -> pd.Series:
    """Sums of squares by row, exact; null past 64 bits."""
    if centred.dtype != object and (centred.astype(float) ** 2).sum(1).max() < _SAFE:
        return pd.Series((centred * centred).sum(1), dtype="Int64")
    exact = [sum(int(c) ** 2 for c in row) for row in centred.tolist()]
    return pd.Series([e if e < 1 << 63 else None for e in exact], dtype="Int64")


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x of the usable rows."""
    entry = lambda c: F.floor(c.cast("double") * scale)
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(1 << 52))
    usable = rows.select("vec_id", F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", good))
    return usable.select("vec_id", F.transform("v", lambda c: entry(c) + F.lit(shift).cast("long")).alias("x"))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of the rows' vectors (arrays of doubles)."""
    vectors = rows.select(array_to_vector(F.col(column)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()


def _whitener(shared):
    """Deviation and whitened entries of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, axes = shared.value
        for frame in frames:
            if len(frame):
                centred = _centred(frame["x"], n, sums)
                whitened = (centred.astype(float) / n) @ axes
                yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": _squares(centred), "whitened": list(whitened)})

    return run


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """rows: vec_id and a column of vectors. A row for each usable row and component:
    vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = whole_vectors(rows, vector, scale, shift)
    # One row for each length.
    lengths = usable.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths["size"]
    usable = usable.where(F.size("x") == width)
    fit = write_table(usable.select("x").distinct(), "whitening-fit")
    totals = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n, sums = totals[0]["n"], np.array([int(r["s"]) for r in sorted(totals, key=lambda r: r["i"])], object)
    moments = spark.sparkContext.broadcast((n, sums))

    def centre(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"d": list(_centred(frame["x"], *moments.value).astype(float) / moments.value[0])})

    covariance = gramian(fit.mapInPandas(centre, "d array<double>"), "d") / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, width)
    trace = np.trace(covariance)
    real = int((values[:count] > max(trace, 0.0) * width * np.finfo(float).eps).sum())
    scaled = axes[:, :real] / np.sqrt(values[:real])
    explained = [float(v / trace) if trace > 0 else 0.0 for v in np.maximum(values[:count], 0.0)]
    run = _whitener(spark.sparkContext.broadcast((n, sums, scaled)))
    error = 0.0
    if real:
        fitted = fit.select(F.lit("").alias("vec_id"), "x").mapInPandas(run, "vec_id string, deviation long, whitened array<double>")
        mean = np.array([r["m"] for r in fitted.select(F.posexplode("whitened").alias("i", "w")).groupBy("i").agg(F.avg("w").alias("m")).orderBy("i").collect()])
        error = float(np.abs(gramian(fitted, "whitened") / n - np.outer(mean, mean) - np.eye(real)).max())
    # As text, whole ids pass by pandas unharmed beside nulls.
    out = usable.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(run, "vec_id string, deviation long, whitened array<double>")
    each = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.struct(i.alias("component"), F.get("whitened", i - 1).alias("whitened"), F.get(F.array(*map(F.lit, explained)), i - 1).alias("explained")))
    return out.select("vec_id", "deviation", F.explode(each).alias("e")).select(
        F.col("vec_id").cast(kind).alias("vec_id"), F.col("e.component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "e.whitened", "e.explained", F.lit(error).alias("identity_error")
    )
