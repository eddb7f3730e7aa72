"""Near-duplicate vectors: randomly rotated binary codes whose estimates decide which pairs are computed exactly."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components, forest
from textloom.llm.scratch import Scratch

COSINE, TILE = 0.98, 8192
#: Bits of a query's coordinates when it is compared with a code; seed of the rotation.
QUERY_BITS, SEED = 6, 11
_ROWS = 256


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix (dim, dim)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Binary codes of unit vectors: the signs of the rotated coordinates, and each code's correction factor <code, vector>."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        turned = unit @ turn.T
        self.dim = unit.shape[1]
        self.words = -(-self.dim // 64)
        self.bits = self._pack(turned > 0)
        self.factor = np.abs(turned).sum(1) / math.sqrt(self.dim)
        top, low = turned.max(1, initial=0), turned.min(1, initial=0)
        self.low, self.step = low, np.maximum(top - low, 1e-12) / ((1 << QUERY_BITS) - 1)
        level = np.rint((turned - low[:, None]) / self.step[:, None]).astype(np.int64)
        self.level_sum = level.sum(1)
        self.planes = [self._pack((level >> b) & 1) for b in range(QUERY_BITS)]
        self.ones = np.bitwise_count(self.bits).sum(1).astype(np.int64)

    def _pack(self, on: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(on), self.words * 64), np.uint8)
        wide[:, : on.shape[1]] = on
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def estimates(self, rows: slice, other: Codes) -> np.ndarray:
        """Unbiased estimates of the inner products of these vectors (rows, as quantised queries) with the others' codes."""
        dots = np.zeros((len(self.low[rows]), len(other.ones)), np.int64)
        for b, plane in enumerate(self.planes):
            for w in range(self.words):
                dots += np.bitwise_count(plane[rows, w][:, None] & other.bits[None, :, w]).astype(np.int64) << b
        # <code, query> = (2 * sum of the query where the code is 1 - sum of the query) / sqrt(dim), query = low + step * level
        low, step = self.low[rows][:, None], self.step[rows][:, None]
        code_dot = 2 * (low * other.ones[None, :] + step * dots) - (low * self.dim + step * self.level_sum[rows][:, None])
        return code_dot / math.sqrt(self.dim) / other.factor[None, :]

    def slack(self, rows: slice, other: Codes, cosine: float) -> np.ndarray:
        """How far an estimate can lie below the cosine of a pair that reaches ``cosine``.

        A code of factor f lies at angle arccos f to its vector o. For a query q with <o, q> = c, <code, q> / f differs
        from c by at most sqrt(1 - f^2) / f * sqrt(1 - c^2) (Cauchy-Schwarz), so this bound holds with confidence 1; the
        lower bound c - ... grows with c, so the threshold itself is the worst case. Rounding a query adds step / 2 in each coordinate.
        """
        spread = np.sqrt(np.clip(1 - other.factor**2, 0, None)) / other.factor * math.sqrt(max(0.0, 1 - cosine**2))
        return spread[None, :] + (self.step[rows] / 2 * math.sqrt(self.dim))[:, None] / other.factor[None, :] + 1e-9


def tile_links(a: np.ndarray, b: np.ndarray | None, turn: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of unit vectors with a cosine of at least ``cosine`` (b None: within a, i < j), and how many pairs were computed exactly."""
    codes = Codes(a, turn)
    other = codes if b is None else Codes(b, turn)
    right, out_i, out_j, exact = a if b is None else b, [], [], 0
    for at in range(0, len(a), _ROWS):
        rows = slice(at, min(at + _ROWS, len(a)))
        near = codes.estimates(rows, other) >= cosine - codes.slack(rows, other, cosine)
        if b is None:
            near &= np.arange(at, rows.stop)[:, None] < np.arange(len(a))[None, :]
        some_i, some_j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(some_i):
            continue
        exact += int(near.sum())
        i, j = np.nonzero(near[np.ix_(some_i, some_j)] & (a[rows][some_i] @ right[some_j].T >= cosine))
        out_i.append(some_i[i] + at)
        out_j.append(some_j[j])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_i]), np.concatenate([empty, *out_j]), exact


def _units(column: pa.Array) -> tuple[list[bytes | None], int]:
    """Each vector divided by its length, as little-endian doubles; None for those that link with nothing."""
    out: list[bytes | None] = []
    for x in column:
        v = None if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype("<f8")
        if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
            out.append(None)
        else:
            v = v / np.abs(v).max()
            out.append((v / np.sqrt(v @ v)).tobytes())
    return out, len(out)


def _compare(cosine: float, seed: int):
    """For each pair of tiles: per node how many rows it links to there, and edges that span the links."""

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            cols = {k: [] for k in ("node", "n", "root")}
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in (0, 1) if batch.column(c)[k].is_valid]
                node, n, unit = [], [], []
                for s in sides:
                    node.append(s.field(0).to_numpy(zero_copy_only=False))
                    n.append(s.field(1).to_numpy(zero_copy_only=False))
                    unit.append(np.frombuffer(b"".join(s.field(2).to_pylist()), "<f8").reshape(len(s), -1))
                dim = unit[0].shape[1]
                turn = turns.setdefault(dim, rotation(dim, seed))
                i, j, _ = tile_links(unit[0], unit[1] if len(unit) > 1 else None, turn, cosine)
                if not len(i):
                    continue
                j = j + (len(node[0]) if len(unit) > 1 else 0)
                node, n = np.concatenate(node), np.concatenate(n)
                links = np.bincount(i, weights=n[j], minlength=len(node)) + np.bincount(j, weights=n[i], minlength=len(node))
                own = np.flatnonzero(links)
                cols["node"].append(node[own])
                cols["n"].append(links[own].astype(np.int64))
                cols["root"].append(node[forest(len(node), i, j)[own]])
            if cols["node"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in cols.values()], list(cols))

    return run


def vector_groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", *, cosine: float = COSINE, tile: int = TILE, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links join equal, non-null labels with a cosine of at least ``cosine``.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, and rows without a label or vec_id link with
    nothing (component_id is their own vec_id). Equal vectors of a label are one class with a count, summed before they
    meet; classes are dealt into tiles of about ``tile`` by a hash, and pairs of tiles are the tasks, so a label of any
    share of the rows spreads over the cluster. Vectors of different lengths never meet. A repeated vec_id is one node
    with several vectors. Every pair within a label is estimated, so no link is lost; the work grows with the square of a
    label's distinct vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def normal(batches):
        for b in batches:
            units, _ = _units(b.column(2))
            labels = b.column(1).to_pylist()
            units = [None if y is None or i is None else u for u, y, i in zip(units, labels, b.column(0).to_pylist(), strict=True)]
            keys = [None if u is None else hashlib.blake2b(u, digest_size=16, salt=y.to_bytes(8, "little", signed=True)).digest() for u, y in zip(units, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "key", "unit"])

    coded = scratch.write(rows.mapInArrow(normal, "vec_id long, label long, key binary, unit binary"), "units")
    classes = scratch.write(coded.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("unit").alias("unit")), "classes")
    group = [F.col("label"), F.length("unit").alias("size")]
    sizes = classes.groupBy(*group).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    sizes = scratch.write(sizes, "sizes")
    tiles = classes.withColumn("size", F.length("unit")).join(sizes, ["label", "size"]).withColumn("tile", F.pmod(F.xxhash64("key"), "tiles"))
    tiles = scratch.write(tiles.groupBy("label", "size", "tile").agg(F.collect_list(F.struct("node", "n", "unit")).alias("members")), "tiles")
    each = sizes.select("label", "size", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    pairs = each.withColumnRenamed("tile", "tile_a").join(each.withColumnRenamed("tile", "tile_b"), ["label", "size"]).where("tile_a < tile_b")
    side = lambda s: tiles.select("label", "size", F.col("tile").alias(f"tile_{s}"), F.col("members").alias(f"members_{s}"))
    across = pairs.join(side("a"), ["label", "size", "tile_a"]).join(side("b"), ["label", "size", "tile_b"]).select("members_a", "members_b")
    alone = tiles.select(F.col("members").alias("members_a"), F.lit(None).cast(tiles.schema["members"].dataType).alias("members_b"))
    work = alone.unionByName(across)
    work = work.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = scratch.write(work.mapInArrow(_compare(cosine, seed), "node long, n long, root long"), "links")
    label_of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("n").alias("found"))
    by_key = scratch.write(classes.select("key", "node", "n").join(links, "node", "left").join(label_of, "node", "left").select("key", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "results")
    out = coded.select("vec_id", "key").join(by_key, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return scratch.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def op2_vectors(spark, sf_dir: str) -> DataFrame:
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x), c AS (SELECT x AS vec_id, min(least(x, y)) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
