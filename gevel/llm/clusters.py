"""Centroid clustering with Shallot search: bounds settle most vectors, a shrinking ball the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.blocks import BLOCKS, floored_means, in_blocks, ints_of, whole_vectors
from gevel.llm.common import forget, keep_table, map_arrow

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: What a float bound may be off by, in proportion; integers decide within it.
SLACK = 1e-9
#: Of each vector: nearest and second-nearest centroid, a bound above the one and one below all others.
STATE = np.dtype([("near", "<i4"), ("second", "<i4"), ("upper", "<f8"), ("lower", "<f8")])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(-1)


class Centroids:
    """Centroids with the distances between them, each one's neighbours sorted by distance."""

    def __init__(self, at: np.ndarray):
        self.at = at
        self.apart = np.sqrt(squared(at[:, None], at[None]).astype(np.float64))
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        off = self.apart + np.diag(np.full(len(at), np.inf))
        self.half = off.min(1) / 2


def start_state(n: int, k: int) -> np.ndarray:
    """Nothing known yet: the first two centroids stand in, with bounds that settle nothing."""
    state = np.zeros(n, STATE)
    state["second"] = min(1, k - 1)
    state["upper"] = np.inf
    return state


def moved(state: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Bounds after the centroids moved: looser by how far they went."""
    shift = np.sqrt(squared(old, new).astype(np.float64)) * (1 + SLACK)
    far = np.full(len(shift), shift.max())
    top = int(shift.argmax())
    far[top] = np.delete(shift, top).max(initial=0.0)
    state = state.copy()
    state["upper"] += shift[state["near"]]
    state["lower"] -= far[state["near"]]
    return state


def assign(x: np.ndarray, state: np.ndarray, centroids: Centroids) -> np.ndarray:
    """The nearest centroid of every vector, ties to the smaller number.

    A vector whose bounds keep all others away is left. The rest measure the nearest
    and the remembered second-nearest centroid and start from the closer one, a: its
    neighbours follow by distance from a, and none further from a than the distance
    to a plus that to the second-best so far can come closer. That ball shrinks with
    every better find. Distances that decide are whole numbers.
    """
    state, k = state.copy(), len(centroids.at)
    if k == 1:
        state["upper"], state["lower"] = np.inf, 0.0
        return state
    bound = np.maximum(state["lower"], centroids.half[state["near"]])
    rows = np.flatnonzero(~(state["upper"] * (1 + SLACK) < bound))
    if not len(rows):
        return state
    p, near, second = x[rows], state["near"][rows].astype(np.int64), state["second"][rows].astype(np.int64)
    best, next_best = squared(p, centroids.at[near]), squared(p, centroids.at[second])
    swap = (next_best < best) | ((next_best == best) & (second < near))
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    best, next_best = np.where(swap, next_best, best), np.where(swap, best, next_best)
    start, other, reach = near.copy(), second.copy(), np.sqrt(best.astype(np.float64))
    live = np.arange(len(rows))
    for step in range(k):
        candidate = centroids.order[start[live], step]
        ball = (reach[live] + np.sqrt(next_best[live].astype(np.float64))) * (1 + SLACK)
        inside = centroids.apart[start[live], candidate] <= ball
        live, candidate = live[inside], candidate[inside]
        if not len(live):
            break
        new = (candidate != start[live]) & (candidate != other[live])
        at, c = live[new], candidate[new]
        d = squared(p[at], centroids.at[c])
        first = (d < best[at]) | ((d == best[at]) & (c < near[at]))
        then = ~first & ((d < next_best[at]) | ((d == next_best[at]) & (c < second[at])))
        up = at[first]
        second[up], next_best[up] = near[up], best[up]
        near[up], best[up] = c[first], d[first]
        second[at[then]], next_best[at[then]] = c[then], d[then]
    state["near"][rows], state["second"][rows] = near, second
    state["upper"][rows], state["lower"][rows] = np.sqrt(best), np.sqrt(next_best)
    return state


SUMS = "sums array<struct<c:int,n:long,s:array<long>>>"
_SUM = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))


def _round(old: np.ndarray | None, new: np.ndarray, dims: int):
    """Blocks with their bounds brought up to date, vectors assigned, and sums by centroid."""
    centroids = Centroids(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, sums = [], []
            for row in batch.select(["n", "vectors", "state"]).to_pylist():
                x = ints_of(row, dims)
                if old is None:
                    state = start_state(row["n"], len(new))
                else:
                    state = moved(np.frombuffer(row["state"], STATE), old, new)
                state = assign(x, state, centroids)
                states.append(state.tobytes())
                own = [(c, x[state["near"] == c]) for c in np.unique(state["near"]).tolist()]
                sums.append([{"c": c, "n": len(v), "s": v.sum(0).tolist()} for c, v in own])
            columns = [*batch.select(["vec_id", "label", "n", "vectors"]).columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(states, pa.binary()), pa.array(sums, _SUM)],
                ["vec_id", "label", "n", "vectors", "state", "sums"],
            )

    return run


def _rows(final: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["vec_id", "vectors", "state"]).to_pylist():
                near = np.frombuffer(row["state"], STATE)["near"]
                far = squared(ints_of(row, dims), final[near])
                columns = [pa.array(row["vec_id"], pa.int64()), pa.array(near), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``1:<vec_id>``; without an id a vector comes last."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(name.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.array([r["vector"] for r in first], np.float64).astype(np.int64)


def cluster(
    rows: DataFrame, dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, and the final centroids.

    Each round is one pass over blocks written to the shared folder: the blocks carry
    the bounds of their vectors from round to round and bring back sums by centroid,
    added up in Spark to k rows. Nothing is shuffled by centroid, so a centroid that
    holds most vectors, or one vector repeated at will, is no hot key.

    Null vectors, other lengths than ``dims``, null, non-finite or overlong components
    (see ``whole_vectors``): no row. Null vec_id: a row like others, a seed only
    when ids run out. Repeated rows each count. Fewer vectors than ``k``: so many
    centroids. No vectors: no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, scale, dims)
    old, new = None, seeds(vectors, k)
    if not len(new):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), new
    blocks, path = keep_table(in_blocks(vectors, dims, lambda _: {"state": b""}, ", state binary"), "vectors")
    for turn in range(rounds + 1):
        done, newer = keep_table(
            map_arrow(blocks, _round(old, new, dims), f"{BLOCKS}, state binary, {SUMS}"), "clusters"
        )
        forget(spark, path)
        blocks, path = done, newer
        if turn == rounds:
            break
        each = done.select(F.explode("sums").alias("x")).select("x.c", "x.n", F.posexplode("x.s").alias("at", "s"))
        sums, counts = np.zeros((len(new), dims), np.int64), np.zeros(len(new), np.int64)
        for r in each.groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            sums[r["c"], r["at"]], counts[r["c"]] = r["s"], r["n"]
        old, new = new, floored_means(sums, counts, new)
    return map_arrow(blocks, _rows(new, dims), "vec_id long, cluster int, distance long"), new


def digest(clustered: tuple[DataFrame, np.ndarray]) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and its centroid's sha256."""
    rows, centroids = clustered
    rows, _ = keep_table(rows, "clustered")
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of([inertia.get(c, 0) for c in range(len(named))] or [0], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(named or [""], "string").alias("centroid_sha256"),
    )


def _sql() -> str:
    parts = [
        f"""with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as a
  from embeddings where len(embedding) = {DIMS}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS}),
c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, a from v
       qualify row_number() over (order by sha256('1:' || vec_id)) <= {CENTROIDS})"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""n{r} as (select vec_id, min({{'d': d, 'c': c}}) as m from (
  select v.vec_id, c.c, list_sum(list_transform(list_zip(v.a, c.a), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d
  from v, c{r} c) group by vec_id)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""s{r} as (select c, i, sum(x) as s, count(*) as n from (
  select n{r}.m.c as c, unnest(v.a) as x, unnest(range({DIMS})) as i from v join n{r} using (vec_id)) group by c, i),
c{r + 1} as (select o.c, coalesce(w.a, o.a) as a from c{r} o left join (
  select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as a from s{r} group by c) w on o.c = w.c)"""
            )
    last = f"n{ROUNDS}"
    return ",\n".join(parts) + f"""
select vec_id, cast({last}.m.c as integer) as cluster, cast({last}.m.d as bigint) as distance,
  cast(sum({last}.m.d) over (partition by {last}.m.c) as bigint) as cluster_inertia,
  cast(sum({last}.m.d) over () as bigint) as inertia, sha256(array_to_string(c.a, ',')) as centroid_sha256
from {last} join c{ROUNDS} c on c.c = {last}.m.c"""


SQL = _sql()
