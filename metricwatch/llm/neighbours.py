"""Nearest neighbours over balanced posting lists: a first search of near lists bounds a second one of all within reach."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.sources import written


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the rows that centroids are fitted on; all rows are indexed.

    ``list_rows`` is the length that lists aim at, while the sample has 8 rows a list at least.
    ``beam`` and ``probe_ratio`` bound the first search of a query only; no result depends on them.
    ``unit_rows`` and ``unit_queries`` bound what a task of the second search holds.
    """

    sample_rows: int = 20_000
    list_rows: int = 250
    replicas: int = 4
    replica_ratio: float = 1.15
    probe_ratio: float = 1.2
    degree: int = 24
    beam: int = 96
    block_rows: int = 2048
    block_queries: int = 512
    unit_rows: int = 16_384
    unit_queries: int = 1024
    seed: int = 5


@dataclass(frozen=True)
class Index:
    """Centroids and a graph of near ones, searched from a few spread entry points."""

    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each point, nearest first, and their distances: best-first search of all points at once."""
        c, n = len(self.centroids), len(points)
        beam = min(beam, c)
        distance = _distances(points, self.centroids[self.entries])
        ids = np.broadcast_to(self.entries, distance.shape)
        if ids.shape[1] < beam:
            fill = beam - ids.shape[1]
            ids = np.concatenate([ids, np.full((n, fill), -1)], axis=1)
            distance = np.concatenate([distance, np.full((n, fill), np.inf)], axis=1)
        order = np.argsort(distance, axis=1)[:, :beam]
        ids, distance = np.take_along_axis(ids, order, 1).copy(), np.take_along_axis(distance, order, 1)
        seen = np.zeros((n, c), dtype=bool)
        seen[:, self.entries] = True
        open_ = ids >= 0
        live = np.arange(n)
        while len(live):
            best = np.argmax(open_[live], axis=1)
            has = open_[live, best]
            live, best = live[has], best[has]
            if not len(live):
                break
            open_[live, best] = False
            near = self.edges[ids[live, best]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            gap = np.linalg.norm(self.centroids[near] - points[live][:, None, :], axis=2)
            gap[~fresh] = np.inf
            merged = np.concatenate([distance[live], gap], axis=1)
            order = np.argsort(merged, axis=1, kind="stable")[:, :beam]
            distance[live] = np.take_along_axis(merged, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), order, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], np.isfinite(gap)], axis=1), order, 1)
        ids[~np.isfinite(distance)] = -1
        return ids, distance


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0))


def fit_index(sample: np.ndarray, leaf: int, settings: Settings) -> Index:
    """Splits the sample in halves across its two means until leaves are small; a leaf's mean is a centroid."""
    rng = np.random.default_rng(settings.seed)
    leaves, work = [], [np.arange(len(sample))]
    while work:
        rows = work.pop()
        own = sample[rows]
        if len(rows) <= leaf or not np.ptp(own, axis=0).any():
            leaves.append(own.mean(axis=0))
            continue
        means = own[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            side = _distances(own, means).argmin(axis=1)
            if side.min() == side.max():
                break
            means = np.stack([own[side == k].mean(axis=0) for k in (0, 1)])
        along = own @ (means[1] - means[0])
        order = np.argsort(along, kind="stable")
        work += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    centroids = np.unique(np.array(leaves), axis=0)
    gaps = _distances(centroids, centroids)
    edges = np.argsort(gaps, axis=1, kind="stable")[:, : settings.degree + 1]
    entries = np.unique(np.linspace(0, len(centroids) - 1, min(len(centroids), 2 * settings.beam)).astype(int))
    return Index(centroids, edges, entries)


def usable(embeddings: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the vectors that take part."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"
        " AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def build_index(rows: DataFrame, settings: Settings) -> Index | None:
    """Fits centroids in one task on the rows with the smallest hashes; the result is as bounded as the sample."""
    n = rows.count()
    if not n:
        return None
    sample = rows.select("v").orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), F.xxhash64("v")).limit(settings.sample_rows)
    leaf = max(8, round(min(n, settings.sample_rows) * settings.list_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = [np.array(v) for b in batches for v in b.column(0).to_pylist()]
        index = fit_index(np.stack(vectors), leaf, settings)
        parts = (index.centroids, index.edges.astype(np.int64), index.entries.astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p.tobytes()], pa.binary()) for p in parts] + [pa.array([len(index.centroids)], pa.int64())], ["a", "b", "c", "n"]
        )

    found = sample.coalesce(1).mapInArrow(run, "a binary, b binary, c binary, n long").first()
    shape = (found["n"], -1)
    return Index(
        np.frombuffer(found["a"]).reshape(shape), np.frombuffer(found["b"], np.int64).reshape(shape), np.frombuffer(found["c"], np.int64)
    )


def posting_lists(rows: DataFrame, index, settings: Settings) -> DataFrame:
    """``(list, vec_id, v, gap, home)``: each vector in its nearest centroid's list, and in those of others almost as near.

    A vector near a boundary, where up to ``replicas`` - 1 further centroids are at most
    ``replica_ratio`` times as far as the nearest, is in all their lists.  ``home`` marks one list a
    vector, and ``gap`` is the distance from the list's centroid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimension = index.value.centroids.shape[1]
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                points = _matrix(part.column(1), dimension)
                ids, gaps = index.value.search(points, 4 * settings.replicas)
                taken = (ids >= 0) & (gaps <= settings.replica_ratio * gaps[:, :1])
                taken[:, settings.replicas :] = False
                # Distances over the range of doubles find no centroid: such vectors are within reach of every query.
                taken[:, 0], ids[:, 0] = True, np.maximum(ids[:, 0], 0)
                row, place = np.nonzero(taken)
                row_at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, place]), part.column(0).take(row_at), part.column(1).take(row_at)]
                    + [pa.array(np.nan_to_num(gaps[row, place], nan=np.inf, posinf=np.inf)), pa.array(place == 0)],
                    ["list", "vec_id", "v", "gap", "home"],
                )

    return rows.mapInArrow(run, "list long, vec_id long, v array<double>, gap double, home boolean")


def probes(queries: DataFrame, index, settings: Settings) -> DataFrame:
    """``(query_id, q, lists)``: the lists whose centroids are at most ``probe_ratio`` times as far as the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                points = _matrix(part.column(1), index.value.centroids.shape[1])
                ids, gaps = index.value.search(points, settings.beam)
                chosen = (ids >= 0) & (gaps <= settings.probe_ratio * gaps[:, :1])
                lists = [own[take].tolist() for own, take in zip(ids, chosen)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64()))], ["query_id", "q", "lists"]
                )

    return queries.mapInArrow(run, "query_id long, q array<double>, lists array<long>")


def within_reach(asked: DataFrame, index, reach: np.ndarray, unit: np.ndarray) -> DataFrame:
    """``(list, query_id, q, bound)``: per query of ``asked`` the units with a list that can hold a vector within ``bound``.

    A list can if its centroid is at most ``reach``, the distance of its farthest vector, further
    away than ``bound``.  ``lists`` of ``asked`` were searched whole and don't count.
    """
    units = int(unit.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = index.value.centroids
        largest = np.sqrt((centroids * centroids).sum(1).max())
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                points, bound = _matrix(part.column(1), centroids.shape[1]), part.column(3).to_numpy()
                # Far over the rounding of the distances.
                slack = 1e-6 * (np.sqrt((points * points).sum(1)) + largest)
                beyond = _distances(points, centroids) - reach > (bound + slack)[:, None]
                row, place = np.nonzero(~beyond & (reach >= 0))
                hit = np.zeros((len(points), units), dtype=np.int64)
                np.add.at(hit, (row, unit[place]), 1)
                for i, own in enumerate(part.column(2).to_pylist()):
                    own = np.array(own, dtype=np.int64)
                    np.subtract.at(hit[i], unit[own[(reach[own] >= 0) & ~beyond[i, own]]], 1)
                row, place = np.nonzero(hit)
                row_at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place)] + [part.column(c).take(row_at) for c in (0, 1, 3)], ["list", "query_id", "q", "bound"]
                )

    return asked.mapInArrow(run, "list long, query_id long, q array<double>, bound double")


def _scan(postings: DataFrame, asked: DataFrame, k: int, block_rows: int, block_queries: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the ``k`` nearest within ``bound`` of every block of every list asked for.

    Lists are cut into blocks of about ``block_rows`` vectors and their queries into blocks of about
    ``block_queries``, so a pair of blocks fits in a task whatever a list's length.
    """
    pieces = lambda df, rows: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("pieces"))
    list_pieces = pieces(postings, block_rows).withColumnRenamed("pieces", "blocks")
    query_pieces = pieces(asked, block_queries).withColumnRenamed("pieces", "turns")
    spread = list_pieces.join(query_pieces, "list")
    left = postings.join(spread, "list").select(
        "list", F.expr("pmod(xxhash64(vec_id), blocks)").alias("block"), F.explode(F.expr("sequence(0L, turns - 1L)")).alias("turn"), "vec_id", "v"
    )
    right = asked.join(spread, "list").select(
        "list", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"), F.expr("pmod(xxhash64(query_id), turns)").alias("turn"), "query_id", "q", "bound"
    )

    def nearest(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if rows.empty or queries.empty:
            return nothing
        points, ids = np.stack(rows["v"]), rows["vec_id"].to_numpy()
        repeats = len(np.unique(ids)) < len(ids)
        norms = (points * points).sum(axis=1)
        out = []
        for first in range(0, len(queries), 128):
            part = queries.iloc[first : first + 128]
            q, bound = np.stack(part["q"]), part["bound"].to_numpy()
            own_norms = (q * q).sum(axis=1)
            # Rough squares by one product; only what may be among the nearest is measured exactly.
            rough = norms + own_norms[:, None] - 2 * (q @ points.T)
            slack = 1e-11 * (norms.max() + own_norms)
            near = ~(rough > (bound**2 + slack)[:, None]) & (ids != part["query_id"].to_numpy()[:, None])
            for i in np.flatnonzero(near.any(axis=1)):
                at = np.flatnonzero(near[i])
                if len(at) > k and not repeats:
                    kth = np.partition(rough[i, at], k - 1)[k - 1]
                    at = at[~(rough[i, at] > kth + 2 * slack[i])]
                score = np.sqrt(((points[at] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((ids[at], score))
                if repeats:
                    order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
                order = order[:k]
                out.append((np.full(len(order), part["query_id"].iloc[i]), ids[at][order], score[order]))
        if not out:
            return nothing
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "vec_id", "score"), zip(*out))})

    keys = ["list", "block", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    distinct = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query, k: int = 10, settings: Settings = Settings(), id_column: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector where ``is_query`` its ``k`` nearest others.

    Scores are Euclidean distances in double precision; ties go to the smaller id.  Each query
    searches the lists near it, then all others that can hold a vector as near as its ``k``-th (all
    lists if it met fewer than ``k``), so the result is exact.  Where distances hardly differ, as
    in many dimensions without clusters, that is most lists: the work grows with queries times rows.

    Vectors that are null, empty, zero, of an uncommon length, hold null or non-finite components
    or have a null id take no part.  Rows that share an id count as one candidate, at the smallest
    distance.  An empty table gives an empty result; other columns are ignored.
    """
    rows = written(usable(embeddings, id_column, vector), "neighbours-rows")
    fitted = build_index(rows, settings)
    if fitted is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index = rows.sparkSession.sparkContext.broadcast(fitted)  # as bounded as the sample
    postings = written(posting_lists(rows, index, settings), "neighbours-lists")
    asked = written(probes(rows.where(is_query), index, settings), "neighbours-asked")
    probed = asked.select(F.explode("lists").alias("list"), "query_id", "q", F.lit(float("inf")).alias("bound"))
    first = written(_best(_scan(postings, probed, k, settings.block_rows, settings.block_queries), k), "neighbours-found")

    home = postings.where("home")
    sizes = home.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("reach")).orderBy("list").collect()  # as bounded as the sample
    reach, length = np.full(len(fitted.centroids), -1.0), np.zeros(len(fitted.centroids), dtype=np.int64)
    for r in sizes:
        reach[r["list"]], length[r["list"]] = r["reach"], r["n"]
    # Neighbouring lists make up units of about as many rows.
    unit_rows = min(max(int(length.sum()) // 64, settings.block_rows), settings.unit_rows)
    unit = np.unique((np.cumsum(length) - length) // unit_rows, return_inverse=True)[1]
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = asked.join(bounds, "query_id", "left").select("query_id", "q", "lists", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    wider = within_reach(bounded, index, reach, unit)
    if wider.isEmpty():
        return first
    units = rows.sparkSession.createDataFrame([(i, int(u)) for i, u in enumerate(unit)], "list long, unit long")
    held = home.join(F.broadcast(units), "list").select(F.col("unit").alias("list"), "vec_id", "v")
    again = _scan(held, wider, k, unit_rows, settings.unit_queries)
    return _best(first.select("query_id", "vec_id", "score").unionByName(again), k)
