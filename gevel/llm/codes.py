"""Vector codes by dual-tree Lloyd: codebooks of eight parts, trees over both parts and entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.blocks import floored_means, in_blocks, ints_of, whole_vectors
from gevel.llm.common import forget, keep_table, map_arrow

PARTS, SCALE, ENTRIES, ROUNDS = 8, 4096, 16, 6
#: Points in a leaf, at most twice as many.
LEAF = 16
#: Copies of a label's sum, so that rows of one label meet it in several tasks.
SALT = 32


def levels_of(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin, the root's first: halves, until nodes have fewer than two leaves' points."""
    levels = [np.array([0, n])]
    while n >= 2 * leaf * (len(levels[-1]) - 1):
        edges = levels[-1]
        levels.append(np.unique(np.concatenate([edges, (edges[1:] + edges[:-1]) // 2])))
    return levels


def grow(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of ``points`` in a tree: each node is halved along its widest side."""
    order = np.arange(len(points))
    for edges in levels_of(len(points), leaf)[:-1]:
        own = points[order]
        side = np.maximum.reduceat(own, edges[:-1]) - np.minimum.reduceat(own, edges[:-1])
        node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        key = np.take_along_axis(own, side.argmax(1)[node][:, None], 1)[:, 0]
        order = order[np.lexsort((key, node))]
    return order


def boxes(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(points, edges[:-1]), np.maximum.reduceat(points, edges[:-1])


class Tree:
    """Nodes by level over points in tree order: edges, boxes and, for parts, sums."""

    def __init__(self, edges, low, high, sums=None):
        self.edges, self.low, self.high, self.sums = edges, low, high, sums

    @classmethod
    def of_entries(cls, points: np.ndarray) -> Tree:
        """Down to single entries."""
        edges = levels_of(len(points), 1)
        if len(edges[-1]) <= len(points):
            edges.append(np.arange(len(points) + 1))
        low, high = zip(*(boxes(points, e) for e in edges))
        return cls(edges, low, high)


def packed(points: np.ndarray) -> bytes:
    """Boxes and sums of all nodes of points in tree order, level by level."""
    out = []
    for edges in levels_of(len(points), LEAF):
        out += [*boxes(points, edges), np.add.reduceat(points, edges[:-1])]
    return b"".join(x.astype(np.int64).tobytes() for x in out)


def unpacked(data: bytes, n: int, width: int) -> Tree:
    edges, at = levels_of(n, LEAF), 0
    held = np.frombuffer(data, np.int64).reshape(-1, width)
    low, high, sums = [], [], []
    for e in edges:
        for to in (low, high, sums):
            to.append(held[at : at + len(e) - 1])
            at += len(e) - 1
    return Tree(edges, low, high, sums)


def children(edges: np.ndarray, finer: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``nodes``: which of them each child comes from, and the children on the finer level."""
    first = np.searchsorted(finer, edges[nodes])
    count = np.searchsorted(finer, edges[nodes + 1]) - first
    of = np.repeat(np.arange(len(nodes)), count)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def lloyd_step(points: np.ndarray, tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code of each point, sums and counts by entry, points left to integers); points in tree order.

    Pairs of a node of points and a node of entries go down both trees level by level.
    No point of a node is further from its nearest entry than the farthest corners of
    the closest pair; a pair whose boxes are further apart than that goes. A node left
    with one entry is assigned whole and adds its cached sum; leaves left with several
    compare their points in integers, ties to the lower index.
    """
    order = grow(book, 1)
    entries = Tree.of_entries(book[order])
    code = np.zeros(len(points), np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    level = down = 0
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        low, high = tree.low[level][node], tree.high[level][node]
        below, above = entries.low[down][entry], entries.high[down][entry]
        least = (np.maximum(0, np.maximum(low - above, below - high)) ** 2).sum(1)
        most = (np.maximum(high - below, above - low) ** 2).sum(1)
        reach = np.full(len(tree.edges[level]) - 1, np.iinfo(np.int64).max)
        np.minimum.at(reach, node, most)
        near = least <= reach[node]
        node, entry = node[near], entry[near]
        last_entry = down == len(entries.edges) - 1
        if last_entry:
            alone = np.bincount(node, minlength=len(reach))[node] == 1
            e = order[entry[alone]]
            np.add.at(sums, e, tree.sums[level][node[alone]])
            edges = tree.edges[level]
            np.add.at(counts, e, np.diff(edges)[node[alone]])
            for k, c in zip(node[alone].tolist(), e.tolist()):
                code[edges[k] : edges[k + 1]] = c
            node, entry = node[~alone], entry[~alone]
        if not len(node):
            return code, sums, counts, 0
        last_node = level == len(tree.edges) - 1
        if last_entry and last_node:
            break
        if not last_node:
            of, node = children(tree.edges[level], tree.edges[level + 1], node)
            entry, level = entry[of], level + 1
        if not last_entry:
            of, entry = children(entries.edges[down], entries.edges[down + 1], entry)
            node, down = node[of], down + 1
    edges = tree.edges[level]
    open_points = np.zeros(len(points), bool)
    distance = np.full((len(points), len(book)), np.iinfo(np.int64).max)
    for e in range(len(book)):
        mine = node[order[entry] == e]
        if len(mine):
            at = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in mine.tolist()])
            distance[at, e] = ((points[at] - book[e]) ** 2).sum(1)
            open_points[at] = True
    at = np.flatnonzero(open_points)
    code[at] = distance[at].argmin(1)
    np.add.at(sums, code[at], points[at])
    np.add.at(counts, code[at], 1)
    return code, sums, counts, len(at)


def _trees(parts: int):
    """For each part its order and the packed nodes."""

    def more(ints: np.ndarray) -> dict[str, bytes]:
        cut = np.split(ints.astype(np.int64), parts, axis=1)
        orders = [grow(p, LEAF) for p in cut]
        return {
            "orders": np.array(orders, np.int32).tobytes(),
            "trees": b"".join(packed(p[o]) for p, o in zip(cut, orders)),
        }

    return more


def _steps(row: dict, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """For each part of a block: its points in tree order, that order, and the step's result."""
    parts, _, width = books.shape
    ints, n = ints_of(row, parts * width), row["n"]
    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, n)
    size = len(row["trees"]) // parts
    for p in range(parts):
        points = ints[:, p * width : (p + 1) * width][orders[p]]
        tree = unpacked(row["trees"][p * size : (p + 1) * size], n, width)
        yield points, orders[p], lloyd_step(points, tree, books[p])


TOTALS = "part int, entry int, at int, n long, s long, open long"


def _totals(books: np.ndarray):
    """What all blocks of a task add up to, a row for each component of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        left = np.zeros(books.shape[0], np.int64)
        for batch in batches:
            for row in batch.select(["n", "vectors", "orders", "trees"]).to_pylist():
                for p, (_, _, (_, s, c, opened)) in enumerate(_steps(row, books)):
                    sums[p] += s
                    counts[p] += c
                    left[p] += opened
        part, entry, at = (x.ravel() for x in np.indices(books.shape))
        columns = [x.astype(np.int32) for x in (part, entry, at)]
        columns += [np.repeat(counts.ravel(), books.shape[2]), sums.ravel(), left[part]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in columns], ["part", "entry", "at", "n", "s", "open"]
        )

    return run


CODES = "vec_id long, label string, code binary, error long"


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.zeros((row["n"], len(books)), np.uint8 if books.shape[1] <= 256 else ">u2")
                error = np.zeros(row["n"], np.int64)
                for p, (points, order, (code, *_)) in enumerate(_steps(row, books)):
                    codes[order, p] = code
                    error[order] += ((points - books[p][code]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["vec_id"], pa.int64()),
                        pa.array(row["label"], pa.string()),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(error),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def compress(
    rows: DataFrame, parts: int = PARTS, scale: int = SCALE, k: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that counts, and the codebooks (part, entry, position).

    Trees over the parts of each block of vectors are built once and written with
    their boxes and sums; every round reads them against trees over the entries and
    brings back one row for each entry component, added up in Spark. ``code`` has a
    byte for each part (two beyond 256 entries).

    Codebooks have the length of the vector with the smallest vec_id whose length is a
    multiple of ``parts``; vectors of other lengths, null vectors and those with null,
    non-finite or overlong components (see ``whole_vectors``) give no row. Null
    vec_id: a row like others, a seed only when ids run out; equal ids follow their
    components. Repeated rows each count. Fewer vectors than ``k``: so many entries. No
    vectors: no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    every = whole_vectors(rows, scale).where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = every.orderBy(*order).select(F.size("vector").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], CODES), np.zeros((parts, 0, 0), np.int64)
    dims = first["n"]
    vectors = whole_vectors(rows, scale, dims)
    start = [r["vector"] for r in vectors.orderBy(*order).limit(k).select("vector").collect()]
    books = np.array(start).astype(np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    blocks, _ = keep_table(in_blocks(vectors, dims, _trees(parts), ", orders binary, trees binary"), "trees")
    for _ in range(rounds):
        totals = map_arrow(blocks, _totals(books), TOTALS).groupBy("part", "entry", "at")
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for r in totals.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            sums[r["part"], r["entry"], r["at"]], counts[r["part"], r["entry"]] = r["s"], r["n"]
        books = np.array([floored_means(s, c, b) for s, c, b in zip(sums, counts, books)])
    return map_arrow(blocks, _codes(books), CODES), books


def digest(compressed: tuple[DataFrame, np.ndarray]) -> DataFrame:
    """Each vector's code in hex, the error of its label and the codebooks' sha256."""
    rows, books = compressed
    rows, _ = keep_table(rows, "codes")
    named = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("grain", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    joined = salted.join(totals, F.col("label").eqNullSafe(F.col("l")) & (F.col("grain") == F.col("salt")))
    return joined.select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(named).alias("codebooks_sha256"),
    )


def _sql() -> str:
    parts = [
        f"""with v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as a,
    len(embedding) // {PARTS} as w
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
p as (select vec_id, g, list_slice(a, g * w + 1, g * w + w) as a from v, range({PARTS}) r(g)),
b0 as (select g, row_number() over (partition by g order by vec_id) - 1 as e, a from p
       qualify row_number() over (partition by g order by vec_id) <= {ENTRIES})"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""n{r} as (select vec_id, g, min({{'d': d, 'e': e}}) as m from (
  select p.vec_id, p.g, b.e, list_sum(list_transform(list_zip(p.a, b.a), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as d
  from p join b{r} b on p.g = b.g) group by vec_id, g)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""s{r} as (select g, e, i, sum(x) as s, count(*) as n from (
  select g, n{r}.m.e as e, unnest(p.a) as x, unnest(range(len(p.a))) as i from p join n{r} using (vec_id, g))
  group by g, e, i),
b{r + 1} as (select o.g, o.e, coalesce(w.a, o.a) as a from b{r} o left join (
  select g, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as a from s{r} group by g, e) w
  on o.g = w.g and o.e = w.e)"""
            )
    last = f"n{ROUNDS}"
    return ",\n".join(parts) + f""",
f as (select vec_id, string_agg(printf('%02x', {last}.m.e), '' order by g) as code,
  cast(sum({last}.m.d) as bigint) as error from {last} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(a, ','), ',' order by g, e)) from b{ROUNDS}) as codebooks_sha256
from f join v using (vec_id)"""


SQL = _sql()
