"""Exact top-k inner products by a Voronoi kNN join.

Queries and data are grouped by their nearest pivot; pivots are rows chosen by a hash, about the square root of the
number of rows and ``most_pivots`` at most, and only steer the work. Of each data group a summary is kept: its radius,
and the ``k + 1`` ids nearest to the pivot with their vectors. The summaries' vectors are real candidates, so the
(k + 1)-th best inner product of a query q with them is a score that q surely reaches, itself left out: t(q).
For a query q of the group with pivot p, ``q.x <= p.x + |q - p| R``, where R is the largest norm of the data. So a row x can
matter to the group only if ``p.x >= s(p)``, where s(p), the least ``t(q) - |q - p| R`` of the group's queries, is one
number for each group; and a whole data group with pivot c and radius r only if ``p.c + |p| r >= s(p)``.

Groups of queries that are near each other share a block of at most ``query_rows`` distinct query vectors (larger groups
have several); a row is copied to just the blocks with a group that it can matter to. A block's data is dealt to
tasks of about ``block_rows`` rows by a hash, where each group of queries meets the rows that passed its bound. If vectors
lie so that no bound excludes anything, what is left is one copy of each row for each block of queries.

Defined results: vectors that are null, empty, of another length than most, or hold null or non-finite components
take no part, neither do rows with a null id; equal scores go to the smaller id; a query is not its own candidate, nor
is any row that shares its id; rows with equal id and vector count once, as queries and as candidates, while an id
with several vectors has a ranking for each; an empty table gives no rows; other columns of the input take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, ship, stored

EPS = 1e-6


def integers(df: DataFrame, vec_id: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): components x as floor(scale * x), of the rows that take part."""
    rows = df.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(vector).cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & whole)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(scale))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = ((pivots**2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
    return g, np.sqrt(np.maximum(((x - pivots[g]) ** 2).sum(axis=1), 0)) + EPS


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity if there are fewer."""
    if score.shape[1] < k:
        return np.full(len(score), -np.inf)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


class Join:
    """The join's parts: ``queries`` (block, g, node, v), ``data`` (block, b, vec_id, v) and the nodes' ids."""

    def __init__(self, df: DataFrame, is_query, k: int, vec_id: str, vector: str, most_pivots: int, block_rows: int, query_rows: int):
        self.spark, self.k = df.sparkSession, k
        ship(self.spark)
        rows = integers(df, vec_id, vector)
        widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
        self.width = int(widths.w) if widths else 0
        if not self.width:
            return
        rows = rows.where(F.size("v") == self.width)
        number = max(4, min(most_pivots, int(np.sqrt(widths["count"]))))
        # At most ``most_pivots`` rows; distinct, so that copies of one vector give one pivot.
        chosen = rows.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(number).collect()
        self.pivots = np.array([r.v for r in chosen], dtype=np.float64)
        self.placed = self._placed(rows)
        self._summarise()
        self._group_queries(is_query, query_rows)
        self.data = self._routed(block_rows)

    def _placed(self, rows: DataFrame) -> DataFrame:
        shared, width = self.spark.sparkContext.broadcast(self.pivots), self.width

        def run(batches):
            for batch in batches:
                g, far = _nearest(_matrix(batch.column(1), width), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "g", "far"])

        return stored(rows.mapInArrow(run, "vec_id long, v array<long>, g int, far double"), "placed")

    def _summarise(self) -> None:
        """Radius and rows of each data group, the largest norm, and the vectors of the ids nearest to the pivots."""
        width, k = self.width, self.k

        def run(batches):
            best: dict[int, list] = {}
            size: dict[int, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, g, far = (batch.column(i).to_numpy() for i in (0, 2, 3))
                norm = np.sqrt((_matrix(batch.column(1), width) ** 2).sum(axis=1))
                order = np.lexsort((ids, far, g))
                cuts = np.flatnonzero(np.diff(g[order])) + 1
                for mine in np.split(order, cuts):
                    group = int(g[mine[0]])
                    n, radius, most = size.get(group, (0, 0.0, 0.0))
                    size[group] = (n + len(mine), max(radius, float(far[mine].max())), max(most, float(norm[mine].max())))
                    near = best.setdefault(group, [])
                    for i in mine.tolist():
                        if len(near) > k and far[i] >= near[k][0]:
                            break
                        if all(int(ids[i]) != other for _, other, _ in near):
                            near.append((float(far[i]), int(ids[i]), batch.column(1)[i].as_py()))
                            near.sort()
                            del near[k + 1 :]
            for group, (n, radius, most) in size.items():
                for i, (far_, id_, v) in enumerate(best[group]):
                    yield pa.RecordBatch.from_pydict({"g": pa.array([group], pa.int32()), "n": pa.array([n if i == 0 else 0]), "r": pa.array([radius]), "norm": pa.array([most]), "far": pa.array([far_]), "vec_id": pa.array([id_]), "v": pa.array([v], pa.list_(pa.int64()))})

        summaries = stored(self.placed.mapInArrow(run, "g int, n long, r double, norm double, far double, vec_id long, v array<long>"), "summaries")
        # As many groups as pivots, and k + 1 rows of each.
        groups = summaries.groupBy("g").agg(F.sum("n").alias("n"), F.max("r").alias("r"), F.max("norm").alias("norm")).collect()
        near = summaries.groupBy("g", "vec_id").agg(F.min(F.struct("far", "v")).alias("s")).withColumn("i", F.row_number().over(W.partitionBy("g").orderBy("s.far", "vec_id")))
        near = near.where(F.col("i") <= k + 1).select("vec_id", "s.v").dropDuplicates(["vec_id"]).collect()
        self.groups = np.array([r.g for r in groups])
        self.rows, self.radius = np.array([r.n for r in groups]), np.array([r.r for r in groups])
        self.norm = max(r.norm for r in groups)
        self.known = np.array([r.v for r in near], dtype=np.float64)

    def _group_queries(self, is_query, query_rows: int) -> None:
        """Distinct query vectors with their groups, and the groups' bounds and blocks."""
        shared, width, k, norm = self.spark.sparkContext.broadcast(self.known), self.width, self.k, self.norm
        pivots = self.spark.sparkContext.broadcast(self.pivots)
        asked = self.placed.where(is_query(F.col("vec_id"))).withColumn("node", F.xxhash64("v"))
        self.ids = asked.select("vec_id", "node").distinct()
        nodes = asked.groupBy("node").agg(F.first("v").alias("v"), F.first("g").alias("g"))

        def run(batches):
            for batch in batches:
                q = _matrix(batch.column(1), width)
                g = batch.column(2).to_numpy()
                far = np.sqrt(np.maximum(((q - pivots.value[g]) ** 2).sum(axis=1), 0)) + EPS
                sure = np.concatenate([_kth(part @ shared.value.T, k + 1) for part in np.array_split(q, max(1, len(q) // 1024))]) if len(q) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sure - far * norm)], names=["node", "v", "g", "s"])

        nodes = stored(nodes.select("node", "v", "g").mapInArrow(run, "node long, v array<long>, g int, s double"), "queries")
        # As many rows as pivots.
        bounds = nodes.groupBy("g").agg(F.count("*").alias("n"), F.min("s").alias("s")).collect()
        p = self.pivots[[r.g for r in bounds]] if bounds else np.zeros((0, width))
        order, left = [], set(range(len(bounds)))
        at = 0 if left else None
        while left:  # each group after the one that it is nearest to
            order.append(at)
            left.discard(at)
            rest = sorted(left)
            at = rest[int((p[rest] @ p[at]).argmax())] if rest else None
        self.query_groups, blocks, held, block = {}, {}, 0, -1
        for i in order:
            r = bounds[i]
            splits = -(-r.n // query_rows)
            if splits > 1 or block < 0 or held + r.n > query_rows:
                block, held = block + 1, 0
            blocks[r.g] = (block, splits)
            self.query_groups[r.g] = (block, splits, r.s)
            held += r.n
            if splits > 1:
                block, held = block + splits - 1, query_rows
        self.blocks = block + 1
        places = self.spark.createDataFrame([(int(g), b, s) for g, (b, s) in blocks.items()], "g int, first int, splits int")
        self.queries = nodes.join(F.broadcast(places), "g").select((F.col("first") + F.pmod(F.xxhash64("node"), F.col("splits"))).cast("int").alias("block"), "g", "node", "v")

    def _routed(self, block_rows: int) -> DataFrame:
        """(block, b, vec_id, v): each row once for every block with a group that it can matter to."""
        width, groups = self.width, self.query_groups
        names = np.array(sorted(groups), dtype=np.int64)
        first, splits, bound = (np.array([groups[g][i] for g in names.tolist()]) for i in range(3))
        p = self.pivots[names] if len(names) else np.zeros((0, width))
        slack = EPS * (1 + np.sqrt((p**2).sum(axis=1)) * self.norm)
        # Which data groups can matter to which query groups: one bound for each pair, from the summaries.
        ahead = p @ self.pivots[self.groups].T + np.sqrt((p**2).sum(axis=1))[:, None] * self.radius >= (bound - slack)[:, None]
        self.survivors = ahead
        size = np.zeros(self.blocks, np.int64)
        for i in range(len(names)):
            for s in range(splits[i]):
                size[first[i] + s] = max(size[first[i] + s], int(self.rows[ahead[i]].sum()))
        parts = np.maximum(1, -(-size // block_rows))
        allowed = np.zeros((len(self.pivots), len(names)), dtype=bool)
        allowed[self.groups] = ahead.T
        shared = self.spark.sparkContext.broadcast((p, bound - slack, first, splits, parts, allowed))

        def run(batches):
            p, least, first, splits, parts, allowed = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    ids = some.column(0).to_numpy()
                    matters = (_matrix(some.column(1), width) @ p.T >= least) & allowed[some.column(2).to_numpy()]
                    needed = np.zeros((len(ids), len(parts)), dtype=bool)
                    for i in range(len(first)):
                        needed[:, first[i] : first[i] + splits[i]] |= matters[:, i, None]
                    who, block = np.nonzero(needed)
                    b = ids[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array((b % parts[block].astype(np.uint64)).astype(np.int32)), some.column(0).take(pa.array(who)), some.column(1).take(pa.array(who))], names=["block", "b", "vec_id", "v"])

        self.parts, self.least = parts, dict(zip(names.tolist(), (bound - slack).tolist(), strict=True))
        return self.placed.select("vec_id", "v", "g").mapInArrow(run, "block int, b int, vec_id long, v array<long>")

    def best(self) -> DataFrame:
        """(node, vec_id, score): of each block and task the candidates with the k + 1 best ids."""
        width, k = self.width, self.k
        shared = self.spark.sparkContext.broadcast((self.pivots, self.least))
        many = F.element_at(F.array(*[F.lit(int(x)) for x in self.parts]), F.col("block") + 1)
        queries = self.queries.withColumn("b", F.explode(F.sequence(F.lit(0), many - 1)))

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            pivots, least = shared.value
            found = []
            if left.num_rows and right.num_rows:
                ids = right["vec_id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], _matrix(right["v"], width)[order]
                repeated = np.zeros(len(ids), dtype=bool)  # rows with equal id and vector count once
                same = np.flatnonzero(ids[1:] == ids[:-1])
                if len(same):
                    spans = np.flatnonzero(np.isin(ids, ids[same]))
                    _, kept = np.unique(np.column_stack([ids[spans], x[spans]]), axis=0, return_index=True)
                    repeated[np.delete(spans, kept)] = True
                q, node, g = _matrix(left["v"], width), left["node"].to_numpy(), left["g"].to_numpy()
                for group in np.unique(g).tolist():
                    mine = np.flatnonzero(g == group)
                    met = np.flatnonzero((x @ pivots[group] >= least[group]) & ~repeated)
                    for at in range(0, len(mine), 256):
                        part = mine[at : at + 256]
                        scores = q[part] @ x[met].T
                        for row, i in zip(scores, part.tolist(), strict=True):
                            # Rows that score as well as the (k + 1)-th best id, or better.
                            take = min(len(row), 2 * k + 2)
                            top = np.argpartition(-row, take - 1)[:take] if take else np.zeros(0, np.int64)
                            if len(np.unique(ids[met[top]])) <= k < len(row):
                                top = np.argsort(-row, kind="stable")
                            if len(top):
                                order = top[np.lexsort((ids[met[top]], -row[top]))]
                                _, opens = np.unique(ids[met[order]], return_index=True)
                                bar = row[order[np.sort(opens)[min(k, len(opens) - 1)]]]
                                good = np.flatnonzero(row >= bar)
                                good = good[np.lexsort((ids[met[good]], -row[good]))]
                                _, opens = np.unique(ids[met[good]], return_index=True)
                                last = np.sort(opens)[min(k, len(opens) - 1)]
                                good = good[: last + 1]
                                found.append((np.full(len(good), node[i]), ids[met[good]], row[good].astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            return pa.table(dict(zip(("node", "vec_id", "score"), columns, strict=True)))

        return queries.groupBy("block", "b").cogroup(self.data.groupBy("block", "b")).applyInArrow(solve, "node long, vec_id long, score long")


def top(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", most_pivots: int = 512, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best of all other rows.

    ``is_query`` takes the id column and tells which rows are queries. Scores are exact integers while they stay
    below 2**53. Equal query vectors are solved once, by a 64-bit hash of the vector."""
    join = Join(df, is_query, k, vec_id, vector, most_pivots, block_rows, query_rows)
    if not join.width:
        return join.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = join.best()
    # k + 1 ids for each node: whichever id a query has, k others are left.
    per_id = found.groupBy("node", "vec_id").agg(F.max("score").alias("best"), F.collect_list("score").alias("scores"))
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("best"), "vec_id"))
    candidates = per_id.withColumn("place", place).where(F.col("place") <= k + 1)
    listed = candidates.groupBy("node").agg(F.collect_list(F.struct("vec_id", "scores")).alias("c"))
    met = join.ids.withColumnRenamed("vec_id", "query_id").join(listed, "node")
    flat = F.flatten(F.transform("c", lambda c: F.transform(c["scores"], lambda s: F.struct((-s).alias("minus"), c["vec_id"].alias("vec_id")))))
    others = F.filter(flat, lambda c: c["vec_id"] != F.col("query_id"))
    ranked = met.select("query_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("rank", "c"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "c.vec_id", (-F.col("c.minus")).alias("score"))
