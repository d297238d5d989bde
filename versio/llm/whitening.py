"""Whitening of embeddings along their leading principal components.

The eigenvectors come from Jacobi-Davidson without a covariance matrix: the
only thing done with the data is a distributed product of the covariance with a
few vectors at a time (every vector is centred before it is multiplied). The
driver holds a basis of at most ``BASIS`` such vectors, takes Rayleigh-Ritz
pairs from it, locks those whose residual has reached double precision and
expands it by corrections, which an inner MINRES finds from the projected
correction equations of all pairs that are not locked yet, side by side.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import remove_table
from .common import shared_path

#: Vectors of the basis before it is cut back to the best ones, vectors kept
#: beside the wanted ones, steps of the inner MINRES, and rounds before giving up.
BASIS, SPARE, INNER_STEPS, ROUNDS = 24, 4, 4, 300
#: Entries that are multiplied at a time.
ENTRIES = 1 << 20
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """What ``fit`` learns: sizes and exact sums of the distinct vectors, and
    the components' eigenvalues and eigenvectors (columns, by falling value)."""

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None


def whole_vectors(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Rows with a usable vector, which becomes ``__x``: longs floor(scale * c).
    Rows whose vector is null or holds null or non-finite entries go."""
    c = F.transform(vector_col, lambda c: c.cast("double"))
    odd = F.exists(c, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~odd).withColumn("__x", F.transform(c, lambda c: F.floor(c * scale)))


def _matrix(col: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as int64 blocks; missing entries at the end are 0."""
    step = max(1, ENTRIES // max(dims, 1))
    for a in range(0, len(col), step):
        part = col.slice(a, step)
        size = part.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(part), dims), np.int64)
        out[np.arange(dims) < size[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
        yield out


def _added(fit: DataFrame, dims: int, size: int, kind: str, f: Callable[[np.ndarray], np.ndarray]) -> list:
    """Sum of ``f`` (``size`` numbers) over blocks of the fit list: per task in
    numpy, over the tasks by an aggregation; only ``size`` numbers reach the driver."""
    number = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for b in batches:
            for x in _matrix(b.column(0), dims):
                acc += f(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(acc, number)], ["i", "v"])

    wide = "decimal(38,0)" if kind == "long" else "double"
    rows = fit.select("__x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum(F.col("v").cast(wide)).alias("v")).collect()
    out = [0] * size
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthonormal to ``basis`` and one another;
    what lies in their span already is left out."""
    out = basis
    for t in new.T:
        before = np.linalg.norm(t)
        for _ in range(3):
            t = t - out @ (out.T @ t)
        left = np.linalg.norm(t)
        if left > 1e-8 * before:
            out = np.column_stack([out, t / left])
    return out[:, basis.shape[1]:]


def _corrections(product, shifts: np.ndarray, away: list[np.ndarray], residuals: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on the correction equations: per column i the t orthogonal to
    ``away[i]`` that makes (I - QQ')(V - shift I)(I - QQ')t + residual smallest
    in the Krylov space of the residual. All columns take a step by one product."""
    def projected(b):
        return np.column_stack([c - q @ (q.T @ c) for c, q in zip(b.T, away, strict=True)])

    start = projected(-residuals)
    norms = np.linalg.norm(start, axis=0)
    lanczos = [start / np.where(norms > 0, norms, 1)]
    band = np.zeros((len(norms), steps + 1, steps))
    for j in range(steps):
        z = projected(product(lanczos[-1]) - lanczos[-1] * shifts)
        for _ in range(2):
            for i, p in enumerate(lanczos):
                along = np.sum(p * z, axis=0)
                band[:, i, j] += along
                z = z - p * along
        size = np.linalg.norm(z, axis=0)
        band[:, j + 1, j] = size
        lanczos.append(z / np.where(size > 0, size, 1))
    cols = []
    for c, norm in enumerate(norms):
        goal = np.zeros(steps + 1)
        goal[0] = norm
        y = np.linalg.lstsq(band[c], goal, rcond=None)[0]
        cols.append(sum(p[:, c] * w for p, w in zip(lanczos, y, strict=False)))
    return np.column_stack(cols)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7
                    ) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and eigenvectors of the
    symmetric operator ``product``, to residuals of double precision."""
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    basis = _orthonormal(rng.standard_normal((dims, min(dims, wanted + SPARE))), locked)
    image = product(basis)
    for _ in range(ROUNDS):
        inner = basis.T @ image
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        tolerance = max(4 * dims, 64) * EPS * max(abs(ritz[0]), *np.abs(values), 0.0)

        def residual(image, basis=basis, ritz=ritz, locked=locked):
            r = image - basis[:, :image.shape[1]] * ritz[:image.shape[1]]
            return r - locked @ (locked.T @ r)

        left = wanted - len(values)
        done = 0
        while done < left and np.linalg.norm(residual(image[:, :done + 1])[:, done]) <= tolerance:
            done += 1
        if done:  # seen in the running images; a fresh product decides
            image[:, :done] = product(basis[:, :done])
            sizes = np.linalg.norm(residual(image[:, :done]), axis=0)
            done = int(np.argmax(np.append(sizes, np.inf) > tolerance))
            locked, values = np.column_stack([locked, basis[:, :done]]), np.append(values, ritz[:done])
            basis, image, ritz = basis[:, done:], image[:, done:], ritz[done:]
            left -= done
        if not left:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if basis.shape[1] + left > BASIS:
            basis, image = basis[:, :left + SPARE], image[:, :left + SPARE]
        away = [np.column_stack([locked, basis[:, i:i + 1]]) for i in range(left)]
        rest = image[:, :left] - basis[:, :left] * ritz[:left]
        new = _orthonormal(_corrections(product, ritz[:left], away, rest, INNER_STEPS), np.column_stack([locked, basis]))
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((dims, left)), np.column_stack([locked, basis]))
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise RuntimeError(f"eigenvectors did not settle in {ROUNDS} rounds")


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = 256) -> Whitening | None:
    """The whitening of the distinct whole-number vectors of a table (each
    counts once); None for a table without any, or only empty ones. It has
    ``components`` components, or as many as the vectors have dimensions."""
    spark = vectors.sparkSession
    path = shared_path(spark, "whitening-fit")
    # copies meet in the partial aggregation of each task already
    whole_vectors(vectors, vector_col, scale).select("__x").distinct().write.parquet(path)
    fit_list = spark.read.schema("__x array<long>").parquet(path)
    try:
        dims = fit_list.agg(F.max(F.size("__x"))).first()[0]
        if not dims:
            return None
        half = np.int64(32)
        parts = _added(fit_list, dims, 2 * dims + 1, "long", lambda x: np.concatenate(
            [(x >> half).sum(axis=0), (x & np.int64((1 << 32) - 1)).sum(axis=0), [len(x)]]))
        n = int(parts[-1])
        sums = [(int(a) << 32) + int(b) for a, b in zip(parts[:dims], parts[dims:-1], strict=True)]
        mean = np.array([s / n for s in sums])

        def product(b: np.ndarray) -> np.ndarray:
            k = b.shape[1]

            def part(x):
                c = x - mean
                return (c.T @ (c @ b)).ravel()
            return np.array(_added(fit_list, dims, dims * k, "double", part)).reshape(dims, k) / n

        values, axes = jacobi_davidson(product, dims, min(components, dims))
        axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
        trace = _added(fit_list, dims, 1, "double", lambda x: np.sum((x - mean) ** 2, keepdims=True).ravel())[0] / n
        out = Whitening(dims, n, sums, values, axes, trace, None)
        use = _has_variance(out)
        if use.any():
            k = int(use.sum())
            into = axes[:, use] / np.sqrt(values[use])
            centre = np.array(_added(fit_list, dims, k, "double", lambda x: ((x - mean) @ into).sum(axis=0))) / n

            def spread(x):
                w = (x - mean) @ into - centre
                return (w.T @ w).ravel()
            cov = np.array(_added(fit_list, dims, k * k, "double", spread)).reshape(k, k) / n
            out.identity_error = float(np.abs(cov - np.eye(k)).max())
        return out
    finally:
        remove_table(spark, path)


def _has_variance(model: Whitening) -> np.ndarray:
    """Components along which the vectors differ beyond rounding."""
    return model.values > model.dims * EPS * model.trace


def transform(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding", scale: int = 256,
              out_col: str = "whitening") -> DataFrame:
    """The usable rows of ``vectors`` with a struct ``out_col``: ``deviation``
    (exact sum over dimensions of (n x - S)^2; null beyond 38 digits) and
    ``whitened`` (a double per component; null without variance along it)."""
    rows = whole_vectors(vectors, vector_col, scale)
    if model is None:
        none = F.struct(F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
        return rows.where("false").withColumn(out_col, none).drop("__x")
    use = _has_variance(model)
    into = np.where(use, model.vectors / np.sqrt(np.where(use, model.values, 1.0)), np.nan)
    n, sums, dims = model.n, model.sums, model.dims
    widest = max(abs(s) for s in sums)

    def run(col: pa.Array) -> pa.Array:
        exact, white = [], []
        for x in _matrix(col, dims):
            far = n * max(abs(int(x.max())), abs(int(x.min()))) + widest
            if dims * far * far < 1 << 63:
                d = n * x - np.array(sums)
                exact.append(pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0)))
            else:  # the same in whole numbers of any length
                d = n * x.astype(object) - np.array(sums, dtype=object)
                exact.append(pa.array([v if abs(v) < 10 ** 38 else None for v in (d * d).sum(axis=1)], pa.decimal128(38, 0)))
            white.append(d.astype(np.float64) / n @ into)
        w = np.concatenate(white) if white else np.zeros((0, into.shape[1]))
        flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN marks no variance
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
        whole = pa.concat_arrays(exact) if exact else pa.array([], pa.decimal128(38, 0))
        return pa.StructArray.from_arrays([whole, lists], ["deviation", "whitened"])

    f = F.arrow_udf(run, "deviation decimal(38,0), whitened array<double>")
    return rows.withColumn(out_col, f(F.col("__x"))).drop("__x")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4,
           scale: int = 256) -> DataFrame:
    """One row per usable row of ``vectors`` and component: ``id, component``
    (from 1), ``n, deviation, whitened, explained, identity_error``.

    Vectors that are null or hold null or non-finite entries take no part;
    shorter vectors are filled with zeros up to the longest. Products beyond
    the range of a long are cut to it. Repeated rows come back as often as they
    came but are fitted once; null ids stay null; other columns are not read.
    Without variance along a component ``whitened`` is null, and ``explained``
    is null if there is none at all. An empty table gives no rows."""
    model = fit(vectors, vector_col, components, scale)
    rows = transform(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), model, "vector", scale)
    out = rows.select("id", "whitening.deviation", F.posexplode("whitening.whitened").alias("at", "whitened"))
    share = [None] * components if model is None or not model.trace else (model.values / model.trace).tolist()
    shares = F.array(*[F.lit(s).cast("double") for s in share])
    return out.select("id", (F.col("at") + 1).alias("component"), F.lit(model and model.n).cast("long").alias("n"), "deviation",
                      "whitened", F.get(shares, F.col("at")).alias("explained"),
                      F.lit(model and model.identity_error).cast("double").alias("identity_error"))
