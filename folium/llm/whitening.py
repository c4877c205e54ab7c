"""Whitening of embeddings with exact covariances by digit-slice GEMM.

An entry c becomes the whole number x = floor(256 c). The fit list is each distinct vector x once. With n vectors of sums S, z = n x - S is centred without any rounding. A task cuts the whole numbers z into limbs of
LIMB bits (the lowest ones not negative, the top one signed), so that a float64 product of two limb matrices of ROWS rows is exact; products of limbs are joined again as whole numbers in base 2 ** DIGIT, and Spark
adds the digits of all tasks. The driver gets one covariance, d x d whole numbers whatever the number of rows, divides it once and decomposes it. Every row is then projected on the leading components.

Defined results: rows whose vector is null or empty, or holds null, NaN or infinite entries, give nothing. Entries beyond 64 bits become the nearest 64-bit number. Vectors have the length that most of the rows have
(of equally many, the greatest); others give nothing. A deviation beyond 64 bits is null. A component without variance (at most d * 2 ** -52 of the trace) has whitened null and counts not in identity_error; where no component has any,
explained and identity_error are null. Repeated rows and rows of a null key are kept, each with its own results. Extra columns of any name are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import stored

SCALE, COMPONENTS = 256, 4
#: Limbs of 20 bits: ROWS products of 40 bits stay below 2 ** 53.
LIMB, ROWS, DIGIT = 20, 1 << 12, 40
#: The covariance of more is not for one driver.
MOST_DIMENSIONS = 1 << 12


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of finite entries as 64-bit numbers."""
    x = np.floor(vectors * float(SCALE))
    out = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(x >= 2.0**63, np.int64(2**63 - 1), out)


def _matrix(column: pa.Array, dimension: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, doubles) of the vectors that are whole and finite; of that dimension, where one is given."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
    starts = np.asarray(column.offsets)
    sizes = np.diff(starts)
    wanted = (sizes == dimension) & np.asarray(column.is_valid())
    rows = np.flatnonzero(wanted)
    made = values[starts[rows][:, None] + np.arange(dimension)] if len(rows) else np.zeros((0, dimension))
    good = np.isfinite(made).all(axis=1)
    return rows[good], made[good]


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in as few bytes an entry as it needs, 2, 4 or 8: equal vectors have equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
    out: list[bytes] = [b""] * len(x)
    for kind, least, limit in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 64)):
        rows = np.flatnonzero((most >= least) & (most < float(limit)))
        if len(rows):
            data = np.ascontiguousarray(x[rows].astype(kind))
            for r, v in zip(rows.tolist(), data):
                out[r] = v.tobytes()
    return out


def _unpacked(packed: list[bytes], dimension: int) -> np.ndarray:
    out = np.empty((len(packed), dimension), np.int64)
    sizes = np.array([len(b) for b in packed]) // dimension
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[rows] = np.frombuffer(b"".join(packed[r] for r in rows), f"<i{size}").reshape(len(rows), dimension)
    return out


def limbs(z: np.ndarray, count: int) -> list[np.ndarray]:
    """z as sum of limb[i] << LIMB * i, as doubles: LIMB bits each, the last one with the sign. z: 64-bit or Python's whole numbers."""
    low = [((z >> (LIMB * i)) & ((1 << LIMB) - 1)).astype(np.float64) for i in range(count - 1)]
    return [*low, (z >> (LIMB * (count - 1))).astype(np.float64)]


def limb_count(most: int) -> int:
    """Limbs for whole numbers of at most this size: the top one has LIMB bits at most, too."""
    return max(1, -(-most.bit_length() // LIMB))


def gram(z: np.ndarray, count: int) -> dict[int, np.ndarray]:
    """z' z as sum of out[s] << LIMB * s, whole numbers of 64 bits: each product of limbs is exact, and at most count of them meet in a sum."""
    parts = limbs(z, count)
    out: dict[int, np.ndarray] = {}
    for i in range(count):
        for j in range(i, count):
            product = (parts[i].T @ parts[j]).astype(np.int64)
            out[i + j] = out.get(i + j, 0) + (product if i == j else product + product.T)
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray, most: int) -> np.ndarray:
    """n x - S, of at most most; as Python's numbers where 64 bits may not do. sums: of Python's numbers."""
    if most < 1 << 63:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _blocks(batches, dimension: int) -> Iterator[np.ndarray]:
    """The fit list's vectors, ROWS of them at most at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _unpacked(batch.column("x").slice(at, ROWS).to_pylist(), dimension)


class Whitening:
    """What fit() finds: n, S, components (columns) with their eigenvalues, the trace and the identity's error."""

    def __init__(self, dimension: int, n: int, sums: np.ndarray, most: int, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.dimension, self.n, self.sums, self.most, self.trace = dimension, n, sums, most, trace
        self.values, self.vectors = values[:COMPONENTS], vectors[:, :COMPONENTS]
        self.real = self.values > trace * dimension * 2.0**-52
        self.error: float | None = None

    def whitened(self, z: np.ndarray) -> np.ndarray:
        """z / n projected, in units of each component's deviation; NaN where it has none."""
        scale = np.where(self.real, np.sqrt(np.where(self.real, self.values, 1.0)), np.nan)
        return (z.astype(np.float64) / self.n) @ self.vectors / scale


def distinct_vectors(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """x: each distinct vector of whole numbers once, packed."""

    def run(batches):
        for batch in batches:
            _, made = _matrix(batch.column(0), dimension)
            yield pa.RecordBatch.from_arrays([pa.array(_packed(whole_numbers(made)), pa.binary())], names=["x"])

    return rows.select(vector).mapInArrow(run, "x binary").groupBy("x").agg(F.count(F.lit(1)).alias("rows"))


def covariance(fit: DataFrame, dimension: int, n: int, sums: np.ndarray, most: int) -> list[list[int]]:
    """Sum of z z' over the fit list, exactly."""
    count = limb_count(most)
    digits = -(-(2 * most.bit_length() + n.bit_length() + 1) // DIGIT) + 1

    def per_task(batches):
        any_rows = False
        held = np.zeros((digits, dimension, dimension), np.int64)
        for k, x in enumerate(_blocks(batches, dimension)):
            for s, part in gram(centred(x, n, sums, most), count).items():
                # into the digits below and above: both shifted parts stay within 64 bits
                digit, shift = divmod(LIMB * s, DIGIT)
                low = part & ((1 << (DIGIT - shift)) - 1)
                held[digit] += low << shift
                held[digit + 1] += part >> (DIGIT - shift)
            if k % 1024 == 1023:
                _carry(held)
            any_rows = True
        if any_rows:
            _carry(held)
            for i in range(dimension):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([held[:, i].tobytes()], pa.binary())], names=["i", "digits"])

    def add(table: pa.Table) -> pa.Table:
        held = np.zeros((digits, dimension), np.int64)
        for part in table.column("digits").to_pylist():
            held += np.frombuffer(part, np.int64).reshape(digits, dimension)
        _carry(held)
        return pa.table({"i": table.column("i").slice(0, 1), "digits": pa.array([held.tobytes()], pa.binary())})

    rows = fit.select("x").mapInArrow(per_task, "i int, digits binary").groupBy("i").applyInArrow(add, "i int, digits binary").collect()
    out: list[list[int]] = [[0] * dimension for _ in range(dimension)]
    for i, packed in rows:
        held = np.frombuffer(packed, np.int64).reshape(digits, dimension).astype(object)
        out[i] = sum(held[k] << (DIGIT * k) for k in range(digits)).tolist()
    return out


def _carry(held: np.ndarray) -> None:
    """Digits to DIGIT bits each; the last keeps the sign."""
    for k in range(len(held) - 1):
        held[k + 1] += held[k] >> DIGIT
        held[k] &= (1 << DIGIT) - 1


def fit(rows: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of a column of vectors; None where no vector is whole."""
    given = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    # a vector with a null, NaN or infinite entry has none in this list
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sizes = given.where((F.size("vector") > 0) & ~bad).groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    found = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    if found is None:
        return None
    dimension = found[0]
    if dimension > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimension} entries: the covariance of more than {MOST_DIMENSIONS} is not held by one driver")
    vectors = stored(distinct_vectors(given, "vector", dimension), "vectors").select("x")

    def per_task(batches):
        n, low, high, most = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64), 0
        for x in _blocks(batches, dimension):
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
            most = max(most, int(x.max()), -int(x.min()))
        if n:
            yield pa.RecordBatch.from_pylist([{"i": i, "n": n, "low": int(low[i]), "high": int(high[i]), "most": str(most)} for i in range(dimension)])

    kinds = "i long, n long, low long, high long, most string"
    made = vectors.mapInArrow(per_task, kinds).groupBy("i").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(30,0)")).alias(c) for c in ("low", "high")], F.max(F.col("most").cast("decimal(20,0)")).alias("most")
    ).orderBy("i").collect()
    n, most = made[0]["n"], int(made[0]["most"])
    sums = np.array([(int(r["high"]) << 32) + int(r["low"]) for r in made], object)
    bound = n * most + max(abs(s) for s in sums)
    exact = covariance(vectors, dimension, n, sums, bound)
    # the quotient of whole numbers is rounded once
    v = np.array([[c / n**3 for c in row] for row in exact])
    values, axes = np.linalg.eigh(v)
    out = Whitening(dimension, n, sums, bound, values[::-1], axes[:, ::-1], sum(exact[i][i] for i in range(dimension)) / n**3)
    out.error = identity_error(vectors, out)
    return out


def identity_error(vectors: DataFrame, fitted: Whitening) -> float | None:
    """The largest absolute entry of whitened's covariance over the fit list minus the identity: every task centres its own, and the parts are merged around the common mean."""
    k = int(fitted.real.sum())
    if not k:
        return None

    def per_task(batches):
        n, mean, held = 0, np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, fitted.dimension):
            w = fitted.whitened(centred(x, fitted.n, fitted.sums, fitted.most))[:, :k]
            n, mean, held = _merged((n, mean, held), (len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "held": held.ravel().tolist()}])

    out = (0, np.zeros(k), np.zeros((k, k)))
    for r in vectors.mapInArrow(per_task, "n long, mean array<double>, held array<double>").collect():  # at most 21 numbers for each task
        out = _merged(out, (r["n"], np.array(r["mean"]), np.array(r["held"]).reshape(k, k)))
    return float(np.abs(out[2] / out[0] - np.eye(k)).max())


def _merged(a, b):
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of every whole row of the fit's dimension and each of its leading components."""
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind)])
    for name, of in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, of)
    fitted = fit(rows, vector)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    given = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    k = len(fitted.values)
    explained = [float(e / fitted.trace) if fitted.trace > 0 else None for e in fitted.values]

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                kept, made = _matrix(batch.column("vector"), fitted.dimension)
                z = centred(whole_numbers(made), fitted.n, fitted.sums, fitted.most)
                m = len(kept)
                w = fitted.whitened(z).ravel()
                if fitted.most**2 * fitted.dimension < 1 << 63:
                    deviation = (z * z).sum(axis=1).tolist()
                else:
                    deviation = [d if d < 1 << 63 else None for d in (int(sum(int(e) ** 2 for e in row)) for row in z)]
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(np.repeat(kept, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)),
                        pa.array(deviation, pa.int64()).take(each), pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()),
                        pa.array([fitted.error] * (m * k), pa.float64())
                    ], names=schema.names
                )

    return given.mapInArrow(run, schema).withColumnRenamed("key", key)
