"""Approximate nearest neighbours: low-dimensional stable projections indexed by kd-tree.

Unit vectors are projected on M Gaussian directions (2-stable: a squared projected distance is the squared
distance times a chi-square variable of M degrees). Blocks are cells of a kd-tree over the projections,
cut at medians of a bounded sample; every row is in a block. In a block, a kd-tree gives projected
neighbours in rising distance; they are verified on whole vectors until a vector as near as the current
k-th would already have come up with probability STOP. The same test prunes blocks: after its own block, a
query goes only to blocks whose bounding box is not further than that.

Equal vectors are one point with its KEEP least ids, so a vector of many copies costs no more than one.
A query's list is merged from its blocks' lists; nothing else of a block leaves its task.

Defined results: null or zero vectors and vectors with null or non-finite components take no part, as
queries or candidates; vectors meet only those of the same length; ties go to the smaller id; rows with
the same id count once for each different vector; too few candidates give fewer rows. Vectors of doubles are kept
and scored as doubles, others as the floats that they are, in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.session import Scratch

M, STOP, LEAF = 8, 0.98, 64
#: Rows of a block that the sample's cuts aim at, rows of the sample, and least rows of a block cut for more cores.
BLOCK_ROWS, SAMPLE_ROWS, SHARE_ROWS = 40_000, 8192, 4096
SALTS = 64


def chi_square(x: np.ndarray) -> np.ndarray:
    """The distribution function for M (even) degrees of freedom."""
    half = np.asarray(x, float) / 2
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(M // 2))


def _stop_ratio() -> float:
    """The squared ratio of projected to true distance at which the test holds."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        lo, hi = ((lo + hi) / 2, hi) if chi_square((lo + hi) / 2) < STOP else (lo, (lo + hi) / 2)
    return hi


RATIO = _stop_ratio()


def directions(n: int) -> np.ndarray:
    return np.random.default_rng(n).standard_normal((n, M))


def _matrix(column: pa.Array | list[bytes], n: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, n).astype(np.float64)


def _parts(raw: bytes, kind: str) -> int:
    return len(raw) // np.dtype(kind).itemsize


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """Leaves of a kd-tree over points, as slices of an order, with their boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                bounds.append((a, b))
                continue
            part = points[self.order[a:b]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], half)]
            todo += [(a, a + half), (a + half, b)]
        self.leaves = sorted(bounds)
        inside = [points[self.order[a:b]] for a, b in self.leaves]
        self.low, self.high = np.array([p.min(0) for p in inside]), np.array([p.max(0) for p in inside])

    def distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(1)


def nearest(tree: Tree, points: np.ndarray, units: np.ndarray, copies: np.ndarray, q_point: np.ndarray, q_unit: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, float]:
    """Verified rows, and the squared distance within which k candidates are known (reach at most)."""
    box = tree.distances(q_point)
    order = np.argsort(box)
    found, dist, pending, pending_at = [], [], np.zeros(0, np.int64), np.zeros(0)
    best, p, take = reach, 0, 8
    while p < len(order) and box[order[p]] <= best * RATIO:
        # leaves in rising distance, in groups that double, so that a group is one vectorised step
        group = order[p : p + take]
        p, take = p + take, 2 * take
        rows = np.concatenate([tree.order[a:b] for a, b in (tree.leaves[leaf] for leaf in group.tolist())])
        pending = np.concatenate([pending, rows])
        pending_at = np.concatenate([pending_at, ((points[rows] - q_point) ** 2).sum(1)])
        upto = box[order[p]] if p < len(order) else np.inf
        due = np.flatnonzero(pending_at <= upto)
        due = due[np.argsort(pending_at[due])]
        lo, some = 0, 64
        while lo < len(due) and pending_at[due[lo]] <= best * RATIO:
            rows = pending[due[lo : lo + some]]
            lo, some = lo + some, 2 * some
            found.append(rows)
            dist.append(((units[rows] - q_unit) ** 2).sum(1))
            d, n = np.concatenate(dist), copies[np.concatenate(found)]
            if len(d) > 8 * k:  # only the nearest count
                near = np.argpartition(d, 8 * k)[: 8 * k]
                d, n = d[near], n[near]
            o = np.argsort(d)
            reached = np.searchsorted(np.cumsum(n[o]), k)
            if reached < len(o):
                best = min(best, float(d[o[reached]]))
        rest = pending_at > upto
        pending, pending_at = pending[rest], pending_at[rest]
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), best


def _search(k: int, kind: str):
    keep = k + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: points of a block (vector, ids). right: queries (query_vector, reach)."""
        names = {"query_vector": pa.binary(), "reach": pa.float64(), "found": pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        vectors = left.column("vector").to_pylist()
        n = _parts(vectors[0], kind)
        raw, ids = _matrix(vectors, n, kind), left.column("ids").to_pylist()
        norms = np.sqrt((raw * raw).sum(1))
        units, g = _unit(raw), directions(n)
        points, copies = units @ g, np.array([len(x) for x in ids])
        tree = Tree(points)
        queries = right.column("query_vector").to_pylist()
        q_raw = _matrix(queries, n, kind)
        q_norms, q_units = np.sqrt((q_raw * q_raw).sum(1)), _unit(q_raw)
        q_points = q_units @ g
        reaches, lists = [], []
        for i, reach in enumerate(right.column("reach").to_pylist()):
            rows, best = nearest(tree, points, units, copies, q_points[i], q_units[i], keep, reach)
            score = (raw[rows] @ q_raw[i]) / (norms[rows] * q_norms[i])
            if len(rows) > keep:  # rows that score below the keep-th cannot be in the list
                high = score >= np.partition(score, len(score) - keep)[len(score) - keep]
                rows, score = rows[high], score[high]
            pairs = sorted((-float(s), v) for s, r in zip(score, rows.tolist(), strict=True) for v in ids[r])[:keep]
            reaches.append(best)
            lists.append([{"score": -s, "vec_id": v} for s, v in pairs])
        return pa.table({"query_vector": pa.array(queries, pa.binary()), "reach": pa.array(reaches, pa.float64()), "found": pa.array(lists, names["found"])})

    return run


def _packed(kind: str):
    """Ids and bytes of the vectors that take part."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)  # nulls are not numbers
            ends = np.cumsum(sizes)
            starts = ends - sizes
            finite, some = (np.concatenate([[0], np.cumsum(x)]) for x in (np.isfinite(flat), flat != 0))
            good = (sizes > 0) & (finite[ends] - finite[starts] == sizes) & (some[ends] > some[starts]) & pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
            raw, size = flat.tobytes(), flat.dtype.itemsize
            out = [raw[size * a : size * b] for a, b in zip(starts[good].tolist(), ends[good].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    return run


def _cuts(sample: list[bytes], depth: int, kind: str) -> dict[int, list]:
    """Per vector length: kd cuts (axis, value) of each inner cell, as nested lists."""

    def cut(points: np.ndarray, left: int):
        if not left or len(points) < 2:
            return None
        axis = int(np.argmax(points.max(0) - points.min(0)))
        value = float(np.median(points[:, axis]))
        return [axis, value, cut(points[points[:, axis] < value], left - 1), cut(points[points[:, axis] >= value], left - 1)]

    by: dict[int, list[bytes]] = {}
    for v in sample:
        by.setdefault(_parts(v, kind), []).append(v)
    return {n: cut(_unit(_matrix(vs, n, kind)) @ directions(n), depth) for n, vs in by.items()}


def _placed(cuts: dict[int, list], kind: str):
    """Adds block and point; vectors of one length are projected together and go down the cuts together."""

    def cells(node, points: np.ndarray, rows: np.ndarray, name: str, out: list[str]) -> None:
        if not node:
            for r in rows.tolist():
                out[r] = name
            return
        right = points[rows, node[0]] >= node[1]
        cells(node[2], points, rows[~right], f"{name}0", out)
        cells(node[3], points, rows[right], f"{name}1", out)

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([_parts(v, kind) for v in vectors], np.int64)
            blocks, points = [""] * len(vectors), np.zeros((len(vectors), M))
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                points[rows] = _unit(_matrix([vectors[r] for r in rows.tolist()], n, kind)) @ directions(n)
                cells(cuts.get(n), points, rows, f"{n}:", blocks)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, M), pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.string()), lists], names=[*batch.schema.names, "block", "point"])

    return run


def search(vectors: DataFrame, queries_where: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For the rows that queries_where (over vec_id) selects, their k nearest: query_id, rank, vec_id, score."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "projection-search")
    kind = "<f8" if dict(vectors.dtypes)[vector_col] == "array<double>" else "<f4"
    own = vectors[vector_col].cast("array<double>" if kind == "<f8" else "array<float>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), own.alias("v")).mapInArrow(_packed(kind), "vec_id bigint, vector binary")
    rows = scratch.write(rows, "rows")
    # The k + 1 least ids of equal vectors, by salted lists, so that a vector of many copies is no hot group.
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salted = rows.groupBy("vector", (F.xxhash64("vec_id") % SALTS).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    points = scratch.write(salted.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")), "points")
    count = points.count()
    sample = [bytes(r.vector) for r in points.orderBy(F.xxhash64("vector")).limit(SAMPLE_ROWS).select("vector").collect()]
    # a block for each core, unless that makes small ones, and no more than BLOCK_ROWS rows in any case
    blocks = max(count / BLOCK_ROWS, min(spark.sparkContext.defaultParallelism, count / SHARE_ROWS), 1)
    depth = math.ceil(math.log2(blocks))
    placed = scratch.write(points.mapInArrow(_placed(_cuts(sample, depth, kind), kind), "vector binary, ids array<bigint>, block string, point array<double>"), "placed")

    asking = rows.where(queries_where).select("vec_id", "vector").distinct()
    queries = placed.join(asking.select("vector").distinct(), "vector", "left_semi").select(F.col("vector").alias("query_vector"), "block", "point")
    schema = "query_vector binary, reach double, found array<struct<score:double,vec_id:bigint>>"
    index = placed.select("block", "vector", "ids")
    go = lambda asked: index.groupBy("block").cogroup(asked.groupBy("q_block")).applyInArrow(lambda a, b: _search(k, kind)(a, b), schema)
    home = scratch.write(go(queries.select(F.col("block").alias("q_block"), "query_vector", F.lit(4.0).alias("reach"))), "home")

    # One row per block comes to the driver; blocks hold BLOCK_ROWS rows on average.
    sides = [F.struct(*[f(F.col("point")[i]).alias(f"x{i}") for i in range(M)]) for f in (F.min, F.max)]
    boxes = [(r.block, list(r.low), list(r.high)) for r in placed.groupBy("block").agg(sides[0].alias("low"), sides[1].alias("high")).collect()]

    def others(batches):
        names, low, high = [b[0] for b in boxes], np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])
        for batch in batches:
            vs, bs, rs = [], [], []
            for v, block, point, reach in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gap = np.maximum(np.maximum(low - point, np.array(point) - high), 0)
                for i in np.flatnonzero((gap * gap).sum(1) <= reach * RATIO).tolist():
                    if names[i] != block and names[i].split(":")[0] == block.split(":")[0]:
                        vs.append(v)
                        bs.append(names[i])
                        rs.append(reach)
            yield pa.RecordBatch.from_arrays([pa.array(bs, pa.string()), pa.array(vs, pa.binary()), pa.array(rs, pa.float64())], names=["q_block", "query_vector", "reach"])

    sent = queries.join(home.select("query_vector", "reach"), "query_vector").select("query_vector", "block", "point", "reach").mapInArrow(others, "q_block string, query_vector binary, reach double")
    away = go(sent)
    lists = home.unionByName(away).select("query_vector", F.explode("found").alias("f")).groupBy("query_vector").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("f.score")).alias("far"), F.col("f.vec_id").alias("vec_id")))), 1, k + 1).alias("found"))
    answered = asking.join(lists, asking["vector"] == lists["query_vector"]).select(F.col("vec_id").alias("query_id"), F.expr(f"slice(filter(found, x -> x.vec_id <> vec_id), 1, {k})").alias("found"))
    return answered.select("query_id", F.posexplode("found").alias("place", "f")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "f.vec_id", (-F.col("f.far")).alias("score"))
