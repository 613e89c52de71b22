"""Operator 1: approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt to shards; each shard's task builds a graph: points enter in
batches, a greedy search over the graph so far proposes neighbours, and of them
those are kept that no kept one is nearer to by the factor ALPHA. The same task
reads the queries in blocks from the shared folder and walks its graph with a
beam; the shards' best are merged. Scores are cosines in double precision on the original vectors.

Vectors that are null, empty or zero or hold null or non-finite components take
no part, as candidates or queries. Vectors of another dimension are in graphs
of their own, and are neighbours only of their like. Equal vectors are one
point with its smallest ids, so that ties go to the smaller id. Rows that repeat
id and vector count once; of a null id nothing is returned. Fewer candidates
than asked for are all returned; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch_path, small_batches

#: Points in a shard and queries in a block, at most on average.
SHARD_POINTS, BLOCK_QUERIES = 4096, 2048
DEGREE, SLACK, ALPHA = 16, 2.0, 1.1
BUILD_BEAM, BEAM = 32, 48
#: Points that enter together, queries walking together, and nodes that a query walks from at a time.
BATCH, CHUNK, STEP = 512, 256, 8


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0.0)
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine & some).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _search(data: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for many queries at once: ids and distances (1 - cosine) of the nearest found, nearest first; -1 where there are fewer."""
    n, q = len(data), len(queries)
    seen = np.zeros((q, n + 1), np.int32)
    seen[:, n] = -1  # stands for no link
    ids = np.full((q, beam), n, np.int32)
    far = np.full((q, beam), np.inf, np.float32)
    ids[:, 0], far[:, 0] = start, 1 - queries @ data[start]
    seen[:, start] = -1
    open_ = np.zeros((q, beam), bool)
    open_[:, 0] = True
    live = np.arange(q)
    while len(live):
        # the nearest ones not walked from yet
        order = np.where(open_[live], far[live], np.inf)
        pick = np.argpartition(order, STEP, 1)[:, :STEP] if beam > STEP else np.broadcast_to(np.arange(beam), order.shape)
        good = np.isfinite(np.take_along_axis(order, pick, 1))
        rows = np.broadcast_to(live[:, None], pick.shape)
        open_[rows[good], pick[good]] = False
        near = np.where(good[..., None], links[ids[rows, pick] % n], n).reshape(len(live), -1)
        r, c = np.nonzero(seen[live[:, None], near] == 0)
        at, row = near[r, c], live[r]
        claim = np.arange(1, len(r) + 1, dtype=np.int32)
        seen[row, at] = claim  # of several links to one node the last counts
        once = seen[row, at] == claim
        r, at = r[once], at[once]
        count = np.bincount(r, minlength=len(live))
        nth = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max(initial=0))
        if width:
            dist, new = np.full((len(live), width), np.inf, np.float32), np.full((len(live), width), n, np.int32)
            new[r, nth] = at
            dist[r, nth] = 1 - np.einsum("ij,ij->i", queries[live[r]], data[at])
            every, named = np.concatenate([far[live], dist], 1), np.concatenate([ids[live], new], 1)
            fresh = np.concatenate([open_[live], new < n], 1)
            best = np.argpartition(every, beam - 1, 1)[:, :beam]
            far[live], ids[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (every, named, fresh))
        live = live[(open_[live] & np.isfinite(far[live])).any(1)]
    order = np.argsort(far, 1, kind="stable")
    found = np.take_along_axis(ids, order, 1).astype(np.int64)
    return np.where(found < n, found, -1), np.take_along_axis(far, order, 1)


def _prune(data: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the proposed neighbours that stay, nearest first: one goes when a kept one is nearer to it by alpha."""
    n = len(data)
    proposed = np.sort(proposed, 1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = n
    proposed = np.where((proposed == points[:, None]) | (proposed < 0), n, proposed)
    vectors = data[proposed % n]
    own = 1 - np.matmul(vectors, data[points][:, :, None])[..., 0]
    own[proposed == n] = np.inf
    order = np.argsort(own, 1)
    own, proposed, vectors = np.take_along_axis(own, order, 1), np.take_along_axis(proposed, order, 1), np.take_along_axis(vectors, order[..., None], 1)
    # whether the k-th hides the l-th
    hides = alpha * np.maximum(1 - np.matmul(vectors, vectors.transpose(0, 2, 1)), 0) <= own[:, None, :]
    stays, count = np.isfinite(own), np.zeros(len(points), np.int64)
    kept = np.full((len(points), degree), n, np.int32)
    for k in range(own.shape[1]):
        on = np.flatnonzero(stays[:, k] & (count < degree))
        kept[on, count[on]] = proposed[on, k]
        count[on] += 1
        stays[on, k + 1 :] &= ~hides[on, k, k + 1 :]
    return kept


def build(data: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Links of each point (len(data): none) and where walks start; ``data`` has unit rows.

    A point may have more than ``degree`` links, up to SLACK times as many,
    before they are pruned again.
    """
    n = len(data)
    width = int(degree * SLACK)
    links = np.full((n, width), n, np.int32)
    middle = data.mean(0)
    start = int((data @ middle).argmax())
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        batch = order[done : done + min(BATCH, max(1, done))]
        proposed = np.concatenate([_search(data, links, start, data[part], beam)[0] for part in np.array_split(batch, -(-len(batch) // CHUNK))])
        links[batch, :degree] = _prune(data, batch, proposed, degree, alpha)
        _link_back(data, links, batch, degree, alpha)
        done += len(batch)
    return links, start


def _link_back(data: np.ndarray, links: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Each new neighbour links back; one that has no room for that is pruned."""
    n, width = links.shape
    source = np.repeat(batch, degree)
    target = links[batch, :degree].ravel()
    source, target = source[target < n], target[target < n]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(first, count)
    room = width - degree
    for low in range(0, int(count.max(initial=0)), room):
        now = (nth >= low) & (nth < low + room)
        used, where = np.unique(target[now], return_inverse=True)
        extra = np.full((len(used), room), n, np.int32)
        extra[where, nth[now] - low] = source[now]
        wide = np.sort(np.concatenate([links[used], extra], 1), 1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = n
        wide.sort(1)
        full = wide[:, width] < n
        links[used[~full]] = wide[~full, :width]
        links[used[full], degree:] = n
        for part in np.array_split(np.flatnonzero(full), -(-int(full.sum()) // BATCH) or 1):
            if len(part):
                links[used[part], :degree] = _prune(data, used[part], wide[part], degree, alpha)


def _level(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to about 1, which is exact."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _level(vectors)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = _level(a), _level(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _walked(graph: tuple, queries: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.Table]:
    """The k nearest found in one shard for each of the queries, block by block."""
    raw, ids, links, start = graph
    data = _unit(raw)
    for block in queries:
        asked, names = _stacked(block.column("q")), block.column("query_id").to_numpy()
        unit = _unit(asked)
        for low in range(0, len(names), CHUNK):
            found, _ = _search(data, links, start, unit[low : low + CHUNK], beam)
            row, col = np.nonzero(found[:, : 4 * (k + 1)] >= 0)
            at = found[row, col]
            scores = cosine(asked[low + row], raw[at])
            best: dict[int, list] = {}
            for r, a, s in zip(row.tolist(), at.tolist(), scores.tolist(), strict=True):
                best.setdefault(r, []).extend((-s, i) for i in ids[a] if i != names[low + r])
            out = [(names[low + r], i, -s) for r, pairs in best.items() for s, i in sorted(pairs)[:k]]
            query, near, score = zip(*out, strict=True) if out else ((), (), ())
            yield pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})


def search_shards(points: DataFrame, asked: str, dimensions: set[int], n_shards: int, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each shard of ``points`` (ids, v) for each query.

    The task that has a shard's points builds its graph and then reads the
    queries of that dimension block by block from the shared folder ``asked``,
    so neither queries nor graphs are shuffled. ``dimensions`` are those that
    have queries; a task that does not find theirs fails.
    """

    def walk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        own = pa.Table.from_batches(list(batches)).sort_by("first")
        raw = _stacked(own.column("v"))
        links, start = build(_unit(raw))
        store, root = fs.FileSystem.from_uri(f"{asked}/d={key[0].as_py()}")
        if key[0].as_py() in dimensions:
            if store.get_file_info(root).type != fs.FileType.Directory:
                raise FileNotFoundError(f"queries in {asked}")
            blocks = dataset.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=BLOCK_QUERIES)
            for found in _walked((raw, own.column("ids").to_pylist(), links, start), blocks, k, beam):
                yield from found.to_batches()

    shard = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(n_shards))
    dealt = points.select(F.size("v").alias("d"), shard.alias("shard"), F.element_at("ids", 1).alias("first"), "ids", "v")
    return dealt.groupBy("d", "shard").applyInArrow(walk, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of which ``is_query`` (over ``id``) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    fine = save(usable(vectors, key, vector).distinct(), "vectors")
    # of equal vectors the k + 1 smallest ids are enough for any query; each task sends no more than that
    ranked = fine.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    points = save(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    n_shards = max(1, -(-points.count() // SHARD_POINTS))
    asked = scratch_path(spark, "queries")
    fine.filter(is_query).select(F.col("id").alias("query_id"), F.size("v").alias("d"), F.col("v").alias("q")).write.partitionBy("d").parquet(asked)
    dimensions = {r["d"] for r in spark.read.parquet(asked).select("d").distinct().collect()} if fine.filter(is_query).limit(1).count() else set()
    found = search_shards(points, asked, dimensions, n_shards, k, beam)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
