"""Operator 11: whitening of embeddings by a tiled covariance.

Sums of every dimension are exact longs (one aggregation).  For the covariance the tasks that read the vectors cut them into
row blocks and each row block into column blocks, as centred doubles; the pairs of column blocks are tiles.  A column block is
sent to the tiles that need it, keyed by tile and a share of the row blocks, a tile's two column blocks of one row block are
multiplied there, and the products are summed for each tile.  What comes to the driver is one number for each pair of
dimensions, never rows; the matrix is put together there and its eigenvectors are taken.  The whitened vectors' own covariance,
for the check against the identity, takes the same way.

A row block is at most BLOCK_BYTES and there are at most TILES column blocks, so a task holds two matrices and one tile.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped; repeated rows and
null ids stay and count; vectors of unlike length are an error, and so are entries whose 64-fold is beyond a long.  Components
whose variance is under NO_VARIANCE of the largest are left out (they cannot be scaled to one), so that equal vectors give no row; equal
eigenvalues may come in either order.  No vectors give an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hand_back, table

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Least width of a column block, and the most column blocks.
TILE, TILES = 32, 8
BLOCK_BYTES = 4 << 20
NO_VARIANCE = 1e-12

_BLOCKS = pa.schema([("tile_i", pa.int32()), ("tile_j", pa.int32()), ("block", pa.int64()), ("side", pa.int32()), ("n_rows", pa.int32()), ("cells", pa.binary())])
_CELLS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])


def usable(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """row_id and v, the vector as doubles, of the rows whose vector is whole and finite."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(row_id).alias("row_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)


class Centre:
    """The fit list's count and sums, and what turns vectors into integer and centred matrices."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.width = n, len(sums)
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s - n * (s // n) for s in sums], dtype=np.int64)

    def steps(self, vectors: pa.Array) -> np.ndarray:
        """x less the whole part of its mean, as longs."""
        c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width)
        return np.floor(SCALE * c).astype(np.int64) + (SHIFT - self.base)

    def centred(self, steps: np.ndarray) -> np.ndarray:
        return steps - self.rest / self.n

    def deviations(self, steps: np.ndarray) -> pa.Array:
        """The exact sums over dimensions of (n x - S)**2."""
        most = int(np.abs(steps).max(initial=0)) + 1
        if self.width * (self.n * most) ** 2 < 1 << 62:
            d = self.n * steps - self.rest
            return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
        d = self.n * steps.astype(object) - self.rest.astype(object)
        return pa.array([Decimal(int(x)) for x in (d * d).sum(axis=1)], pa.decimal128(38, 0))


def fit_centre(vectors: DataFrame) -> Centre | None:
    """Counts and sums of every dimension; None without vectors."""
    x = F.floor(SCALE * F.col("c")).cast("long") + SHIFT
    found = vectors.select(F.posexplode("v").alias("d", "c")).groupBy("d").agg(F.count("*").alias("n"), F.sum(x).alias("s")).orderBy("d").collect()
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of unlike length")
    return Centre(found[0]["n"], [r["s"] for r in found]) if found else None


def tiled_products(vectors: DataFrame, centre: Centre, axes: np.ndarray | None = None) -> np.ndarray:
    """The mean over rows of the products of all pairs of columns: of the centred vectors, or of their projections on axes."""
    width = centre.width if axes is None else axes.shape[1]
    step = max(TILE, -(-width // TILES))
    cuts = [(a, min(a + step, width)) for a in range(0, width, step)]
    block_rows = max(16, BLOCK_BYTES // (8 * width))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, 2 * parts // (len(cuts) * (len(cuts) + 1) // 2))

    def cut(batches):
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            for k in range(0, b.num_rows, block_rows):
                m = centre.centred(centre.steps(b.column("v").slice(k, block_rows)))
                m = m if axes is None else m @ axes
                sides = [np.ascontiguousarray(m[:, a:z]).tobytes() for a, z in cuts]
                rows = [(i, j, at, side, len(m), sides[c]) for i in range(len(cuts)) for j in range(i, len(cuts)) for side, c in enumerate((i, j) if i < j else (i,))]
                at += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)
        hand_back()

    def summed(tile, total):
        (a, _), (b, _) = cuts[tile[0]], cuts[tile[1]]
        i, j = np.indices(total.shape, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(i.ravel() + np.int32(a)), pa.array(j.ravel() + np.int32(b)), pa.array(total.ravel())], schema=_CELLS)

    def multiply(batches):
        tile, total, left = None, None, None
        for b in batches:
            for i, j, side, n, cells in zip(*(b.column(c).to_pylist() for c in ("tile_i", "tile_j", "side", "n_rows", "cells")), strict=True):
                m = np.frombuffer(cells).reshape(n, -1)
                if side == 0 and i < j:
                    left = m
                    continue
                if tile != (i, j):
                    if tile:
                        yield summed(tile, total)
                    tile, total = (i, j), 0.0
                total = total + (m if i == j else left).T @ m
        if tile:
            yield summed(tile, total)
        hand_back()

    blocks = vectors.mapInArrow(cut, "tile_i int, tile_j int, block long, side int, n_rows int, cells binary")
    dealt = blocks.repartition("tile_i", "tile_j", F.pmod(F.xxhash64("block"), F.lit(shares))).sortWithinPartitions("tile_i", "tile_j", "block", "side")
    sums = dealt.mapInArrow(multiply, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for r in sums.toLocalIterator():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"] / centre.n
    return out


def whiten(df: DataFrame, row_id: str = "vec_id", column: str = "embedding", most: int = MOST) -> DataFrame:
    """row_id, component, n, deviation decimal(38,0), whitened, explained and identity_error for each usable row and component."""
    spark = df.sparkSession
    kind = df.schema[row_id].dataType
    vectors = usable(df, row_id, column)
    result = f"{row_id} {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    centre = fit_centre(vectors)
    if centre is None:
        return spark.createDataFrame([], result)
    covariance = tiled_products(vectors, centre)
    values, axes = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values) if values[k] > NO_VARIANCE * values.max() and values[k] > 0][:most]
    if not order:
        return spark.createDataFrame([], result)
    scaled = axes[:, order] / np.sqrt(values[order])
    explained = values[order] / np.trace(covariance)
    error = float(np.abs(tiled_products(vectors, centre, scaled) - np.eye(len(order))).max())

    def project(batches):
        k = len(order)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                steps = centre.steps(part.column("v"))
                row = pa.array(np.repeat(np.arange(part.num_rows), k))
                columns = [
                    part.column("row_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(row), centre.n)),
                    centre.deviations(steps).take(row), pa.array((centre.centred(steps) @ scaled).ravel()), pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(len(row), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, result)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
