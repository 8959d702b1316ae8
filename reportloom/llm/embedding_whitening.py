"""Embedding whitening by Jacobi-Davidson.

The covariance is never formed: its product with a block of directions is one pass over
the centred rows, in which each task returns a small partial sum. Around this product
works a block Jacobi-Davidson iteration. Rayleigh-Ritz in a subspace gives the current
eigenpairs; converged ones are locked and kept out of the rest; for the others the
correction equation, projected off what is locked and off the current vectors, is solved
roughly by a few steps of MINRES, all of them side by side, and the corrections widen the
subspace, which is cut back to its best vectors once it is large.

Entries are integers, shifted by the rounded mean before anything is multiplied, so
centring loses no digits whatever their offset.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import ship, stored, table

EPS = float(np.finfo(float).eps)
#: Entries of a block of rows, about.
BLOCK = 1 << 17

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, by at most so many steps; ends once all residuals fell to ``enough``."""
    size = lambda x: np.sqrt((x * x).sum(axis=0))
    over = lambda x, y: np.divide(x, y, out=np.zeros(np.broadcast_shapes(x.shape, y.shape)), where=y > 0)
    zero = np.zeros(right.shape[1])
    whole = size(right)
    eta, beta = whole.copy(), zero
    v, v_before = over(right, whole), np.zeros_like(right)
    w = w_before = x = np.zeros_like(right)
    c0, c1, s0, s1 = zero + 1, zero + 1, zero, zero
    for _ in range(steps):
        image = apply(v) - beta * v_before
        alpha = (v * image).sum(axis=0)
        image = image - alpha * v
        after = size(image)
        delta = c1 * alpha - c0 * s1 * beta
        rho1, rho2, rho3 = np.hypot(delta, after), s1 * alpha + c0 * c1 * beta, s0 * beta
        c0, s0, c1, s1 = c1, s1, over(delta, rho1), over(after, rho1)
        w, w_before = over(v - rho3 * w_before - rho2 * w, rho1), w
        x = x + c1 * eta * w
        eta = -s1 * eta
        v, v_before, beta = over(image, after), v, after
        if (np.abs(eta) <= enough * whole).all():
            break
    return x


def _without(x: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for basis in bases:
            x = x - basis @ (basis.T @ x)
    return x


def jacobi_davidson(product: Product, size: int, wanted: int, spare: int = 4, steps: int = 8, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric operator, falling, and unit eigenvectors as columns.

    ``product`` applies it to the columns of a block. A pair is done once its residual is
    that of double precision: some rounding errors of the largest eigenvalue, or where
    rounding lets it fall no further.
    """
    wanted = min(wanted, size)
    done, values = np.zeros((size, 0)), np.zeros(0)
    if not wanted:
        return values, done
    basis, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((size, min(size, wanted + spare))))
    image = product(basis)
    most = max(3 * wanted, wanted + 4 * spare)
    best, stuck = np.inf, 0
    for _ in range(rounds):
        inner = basis.T @ image
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        left = wanted - len(values)
        rest = image[:, :left] - basis[:, :left] * ritz[:left]
        wide = np.sqrt((rest * rest).sum(axis=0))
        top = max(np.abs(ritz).max(), np.abs(values).max(initial=0.0))
        stuck = stuck + 1 if wide.max() >= best / 2 and wide.max() <= 1e-10 * top else 0
        best = min(best, wide.max())
        fine = wide <= (16 * EPS * np.sqrt(size) * top if stuck < 2 else 1e-10 * top)
        locked = left if fine.all() else int(np.argmin(fine))
        if locked:  # in order, so that none is passed over
            done, values = np.c_[done, basis[:, :locked]], np.r_[values, ritz[:locked]]
            basis, image, ritz, rest, wide = basis[:, locked:], image[:, locked:], ritz[locked:], rest[:, locked:], wide[locked:]
            left, best, stuck = left - locked, np.inf, 0
        if not left:
            order = np.argsort(-values, kind="stable")
            return values[order], done[:, order]
        room = size - done.shape[1] - basis.shape[1]
        if not room:  # the subspace is the whole space: only rounding is left, which a fresh image mends
            basis, _ = np.linalg.qr(_without(basis, done))
            image = product(basis)
            continue
        off = (done, basis[:, :left])
        open_ = np.flatnonzero(~(wide <= 16 * EPS * np.sqrt(size) * top))
        theta = ritz[open_]
        correction = minres(lambda t, off=off, theta=theta: _without(product(t := _without(t, *off)) - theta * t, *off), _without(-rest[:, open_], *off), steps, 0.1)
        if basis.shape[1] + len(open_) > most:
            basis, image = basis[:, : left + spare], image[:, : left + spare]
        length = np.sqrt((correction * correction).sum(axis=0))
        fresh = _without(correction[:, length > 0] / length[length > 0], done, basis)
        turned, weight, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = _without(turned[:, weight > 1e-8], done, basis)[:, :room]
        if not fresh.shape[1]:  # no direction left to add: go on in a random one
            fresh = _without(np.random.default_rng(len(values)).standard_normal((size, 1)), done, basis)
        fresh, _ = np.linalg.qr(fresh)
        fresh = _without(fresh, done, basis)
        basis, image = np.c_[basis, fresh], np.c_[image, product(fresh)]
    raise ArithmeticError(f"{wanted - len(values)} of {wanted} eigenvectors did not converge in {rounds} rounds.")


class Rows:
    """Centred rows in blocks, and sums over all of them."""

    def __init__(self, blocks: DataFrame, size: int, offset: np.ndarray):
        self.blocks, self.size, self.offset = blocks, size, offset

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``part`` over the centred blocks; tasks and then Spark add up, and one small array comes back."""
        size, offset = self.size, self.offset

        def run(batches):
            sums = np.zeros(shape)
            for batch in batches:
                for raw in batch.column("y"):
                    sums += part(np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, size) - offset)
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()])], ["v"])

        found = self.blocks.select("y").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
        out = np.zeros(int(np.prod(shape)))
        for r in found.groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(shape)


def embedding_whitening(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    components: int = 32, scale: int = 64, shift: int = 1_000_000,
) -> DataFrame:
    """Per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes the integer ``floor(scale * c) + shift``. Components are numbered
    from 1 by falling eigenvalue of the covariance (divisor n) of these integers; each one's
    largest entry is positive. ``whitened`` is the centred vector along the component over
    the root of the eigenvalue; ``deviation`` n * n times the squared distance from the mean,
    exact, null where a long can't hold it; ``explained`` the eigenvalue over their sum;
    ``identity_error`` how far the whitened covariance is from the identity anywhere.

    Dropped: vectors that are null or empty, hold null or non-finite entries or entries that
    54 bits don't hold once scaled, and, since all must have one length, those of another
    than the commonest length (of equally common ones the longest). Components without
    variance are left out, so equal vectors alone give no rows. Rows are taken one by one:
    repeated rows and null ids stay. Extra columns are ignored; an empty table gives no rows.

    The rows are written once to the shared folder as blocks and read once a product. The
    driver holds blocks of as many numbers as a vector times three times the components.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("e")
    fits = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(2.0**53)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where(e.isNotNull() & (F.size(e) > 0) & fits)
    rows = rows.select("id", F.size(e).alias("dim"), F.transform(e, lambda c: F.floor(c * scale) + F.lit(shift)).alias("x"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size, n = common["dim"], common["count"]
    rows = rows.where(F.col("dim") == size)

    def add(batches):
        """Sums by place; Python's integers hold what a long doesn't."""
        sums = np.zeros(size, dtype=object)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            sums += (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & 0xFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(s) for s in sums.tolist()])], ["at", "s"])

    sums = rows.select("x").mapInArrow(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = {r["at"]: int(r["s"]) for r in sums.collect()}
    middle = [round(Fraction(total[k], n)) for k in range(size)]
    rest = [total[k] - n * middle[k] for k in range(size)]  # what n times the shifted rows sum up to

    def pack(batches):
        least = np.array(middle, dtype=np.int64)
        for batch in batches:
            y = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - least
            for at in range(0, len(y), max(1, BLOCK // size)):
                part = y[at : at + max(1, BLOCK // size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, len(part)], batch.column("id").slice(at, len(part))), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())],
                    ["ids", "y"],
                )

    blocks, _ = stored(rows.select("id", "x").mapInArrow(pack, f"ids array<{id_type}>, y binary"))
    mean = np.array([float(Fraction(r, n)) for r in rest])
    centred = Rows(blocks, size, mean)
    trace = float(centred.total(lambda c: np.array([(c * c).sum()]), (1,))[0]) / n
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, axes = jacobi_davidson(lambda w: centred.total(lambda c: c.T @ (c @ w), w.shape) / n, size, components)
    real = values > size * EPS * values.max()
    values, axes = values[real], axes[:, real]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    turn = axes / np.sqrt(values)
    k = len(values)
    moments = centred.total(lambda c: np.c_[np.ones(len(c)), c @ turn].T @ (c @ turn), (k + 1, k)) / n
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(k)).max())
    explained = (values / trace).tolist()

    def project(batches):
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("y"), strict=True):
                y = np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, size)
                m = len(y)
                high = n * max(int(y.max()), -int(y.min())) + max(map(abs, rest))
                if size * high * high < 1 << 63:
                    far = ((n * y - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    far = ((n * y.astype(object) - np.array(rest, dtype=object)) ** 2).sum(axis=1).tolist()
                    far = [f if f < 1 << 63 else None for f in far]
                names = ids.values.take(pa.array(np.repeat(np.arange(m), k)))
                arrays = [
                    names, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(((y - mean) @ turn).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = blocks.mapInArrow(project, f"_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(table(spark, sf_dir, "embeddings"))
