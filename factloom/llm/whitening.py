"""Whitening of embeddings by the singular value decomposition of centred rows.

Entries become whole numbers, so that sums over any number of rows are exact. Each distinct vector counts once for the
fit: with n of them and the sums S of each dimension, a row's deviation is n * x - S, exact in decimals, and its centred
value that deviation over n. MLlib's ``computeSVD`` of the distributed centred rows gives the components; a singular value
s is rescaled to the eigenvalue s ** 2 / n of the covariance with divisor n. All components are asked for, so that the
decomposition is direct and to double precision; those that whiten are the first ones. The total variance doesn't come from singular
values but from the exact deviations.

Only sums, the components and the Gram matrix (dimensions squared) reach the driver.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are rows of another
number of entries than most rows have (of equally many, the longer ones stay). Entries beyond +-10**9 after scaling are
taken as +-10**9. Directions without variance (singular values up to ``FLAT`` of the first) can't be scaled to one and give no component; where all
rows are alike, or there are none, there are no components and so no rows. Repeated rows are all returned and count once. A null id is an id. Columns of any
name may be there; only the id is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, scratch, unused

SCALE, SHIFT, BOUND = 64.0, 1_000_000, 10**9
COMPONENTS = 16
FLAT = 1e-7


def whole(vector: Column) -> Column:
    """A vector's entries as whole numbers."""

    def number(c: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(2.0 * BOUND)), F.lit(-2.0 * BOUND)))
        return F.greatest(F.least(scaled + SHIFT, F.lit(BOUND)), F.lit(-BOUND)).cast("long")

    return F.transform(vector, number)


def usable(vector: Column) -> Column:
    """False for null and empty vectors and for those with null or non-finite entries."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)), F.lit(False))


@dataclass
class Whitener:
    n: int
    sums: list[int]
    #: Unit eigenvectors of the covariance, one a column, their eigenvalues, and the trace of the covariance.
    components: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: Column) -> Column:
        """n * x - S of each dimension, exact."""
        sums = F.array(*[F.lit(s).cast("decimal(38,0)") for s in self.sums])
        return F.zip_with(x, sums, lambda c, s: (F.lit(self.n).cast("decimal(12,0)") * c.cast("decimal(11,0)")).cast("decimal(38,0)") - s)

    def project(self, centred: Column) -> Column:
        """The centred row on each component, over the root of its eigenvalue."""
        by = self.components / np.sqrt(self.values) if len(self.values) else np.zeros((len(self.sums), 0))

        @F.arrow_udf("array<double>")
        def on(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = np.asarray(batch.flatten(), np.float64).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(by)))
                out = rows @ by
                offsets = np.arange(len(batch) + 1, dtype=np.int32) * by.shape[1]
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

        return on(centred)


def rows_of(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, str]:
    """The usable rows of the usual length, with a column of whole numbers, whose name is told too."""
    x = unused(vectors, "x")
    kept = vectors.where(usable(F.col(f"`{vector_col}`"))).withColumn(x, whole(F.col(f"`{vector_col}`")))
    usual = kept.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size(x) == (usual["d"] if usual else 0)), x


def squared(deviations: Column) -> Column:
    """Sum of the squares of exact deviations."""
    return F.aggregate(deviations, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + (d * d).cast("decimal(38,0)")).cast("decimal(38,0)"))


def centred(deviations: Column, n: int) -> Column:
    return F.transform(deviations, lambda d: d.cast("double") / F.lit(float(n)))


def fit(x: DataFrame, k: int) -> tuple[Whitener, DataFrame]:
    """A whitener of ``k`` components at most, from the column ``x`` of distinct whole-number vectors, a stored table; and the table of
    ``centred`` rows."""
    d = len((x.first() or [[]])[0])
    told = x.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.get("x", i).cast("decimal(11,0)")), F.lit(0)).alias(f"s{i}") for i in range(d)]).first()
    model = Whitener(told["n"], [int(told[f"s{i}"]) for i in range(d)], np.zeros((d, 0)), np.zeros(0), 0.0)
    far = x.select(model.deviations(F.col("x")).alias("far"))
    rows = cut(far.select(centred(F.col("far"), max(model.n, 1)).alias("centred"), squared(F.col("far")).alias("square")), "centred-rows")
    total = rows.agg(F.coalesce(F.sum("square"), F.lit(0)).alias("t")).first()["t"]
    if not total:
        return model, rows
    model.trace = float(Decimal(total) / model.n**3)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("centred").alias("v")), "v")
    svd = RowMatrix(vectors).computeSVD(d, computeU=False, rCond=FLAT)
    values = np.array(svd.s.toArray()) ** 2 / model.n
    model.values, model.components = values[:k], svd.V.toArray()[:, : len(values)][:, :k]
    return model, rows


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """Largest entry, in absolute value, of the covariance of the whitened ``rows`` minus the identity: one more pass."""
    k = len(model.values)
    white = rows.select(model.project(F.col("centred")).alias("w"))
    mean = white.agg(*[F.avg(F.get("w", i)).alias(f"m{i}") for i in range(k)]).first()
    own = [F.get("w", i) - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    told = white.agg(*[F.avg(own[i] * own[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector: its id, ``whitened`` (array, one entry a component), ``explained`` (array: each component's
    share of the total variance), ``n`` (distinct vectors), ``deviation`` (exact decimal: sum of (n * x - S) ** 2) and ``identity_error``."""
    kept, x = rows_of(vectors, vector_col)
    with scratch(vectors.sparkSession):
        distinct = cut(kept.select(F.col(x).alias("x")).distinct(), "distinct-vectors")
        model, rows = fit(distinct, k)
        error = identity_error(rows, model) if len(model.values) else None
    far = kept.select(F.col(f"`{id_col}`"), model.deviations(F.col(x)).alias("far"))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    return far.select(
        f"`{id_col}`", F.lit(model.n).cast("long").alias("n"), squared(F.col("far")).alias("deviation"),
        model.project(centred(F.col("far"), max(model.n, 1))).alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1; ``deviation`` as long, null where it has more digits."""
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    rows = whitened.select(f"`{id_col}`", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", parts)
    return rows.select(
        f"`{id_col}`", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), "identity_error",
    )
