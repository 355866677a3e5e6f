"""Embedding near-dedup with an inverted multi-index.

Independent codebooks on the two halves of the vectors span a grid of cells. Every vector is
indexed in its cell; as a query it visits cells in order of distance (multi-sequence traversal)
as many as the target recall takes, and is compared there in double precision. Equal vectors are
one vector with a count, so a hot vector costs one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import stored, table
from corvane.llm.graph import components

#: Vectors the codebooks are fitted on at most; largest codebook (the grid has its square); probes that set the number of cells.
SAMPLE, LARGEST, PROBES = 16_384, 1024, 768
#: Members or queries of a cell compared in one task.
BLOCK = 4096


def fit_codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centres of rows of x, from a seeded start; an empty cluster takes a row far from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        own = d.argmin(1)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums / np.maximum(sizes, 1)[:, None]
        if (empty := np.flatnonzero(sizes == 0)).size:
            centres[empty] = x[np.argsort(-d.min(1), kind="stable")[: empty.size]]
    return centres


def half_distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return tuple((half * half).sum(1)[:, None] - 2 * half @ c.T + (c * c).sum(1) for half, c in zip((x[:, :h], x[:, h:]), books, strict=True))


def traverse(first: np.ndarray, second: np.ndarray, cells: int) -> list[int]:
    """The `cells` nearest cells to one query, from its distances to both codebooks, nearest first.

    A heap holds the frontier: a pair of ranks enters when both pairs before it have left.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb, k = first[a].tolist(), second[b].tolist(), len(b)
    heap, out, reached = [(fa[0] + sb[0], 0, 0)], [], [0] * len(a)
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * k + int(b[j]))
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (fa[i + 1] + sb[j], i + 1, j))
        if j + 1 < k and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
    return out


def cells_for(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float, seed: int = 11) -> int:
    """Cells a query must visit so that the share `recall` of partners is met.

    Partners are drawn around sampled vectors in random directions, at the threshold cosine: at least
    as far as real ones; the rank of their cell among the query's cells is what counts.
    """
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(PROBES, len(sample)), replace=False)]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.maximum(np.linalg.norm(u, axis=1), 1e-30)[:, None]
    y = cosine * x + np.sqrt(1 - cosine * cosine) * u
    dx, dy = half_distances(x, books), half_distances(y, books)
    rows = np.arange(len(x))
    reached = dx[0][rows, dy[0].argmin(1)] + dx[1][rows, dy[1].argmin(1)]
    ranks = np.sort([int((dx[0][i][:, None] + dx[1][i] < reached[i]).sum()) + 1 for i in rows])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))])


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix, scaled to length 1 in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    x = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return _directions(x)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links a-b among n nodes, the smallest node each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable(column: str) -> F.Column:
    """Whether a vector has a direction: not null, empty or zero, no component null or non-finite."""
    v = F.col(column)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def near_links(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.99, id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, node), groups of equal vectors (node, least id, copies, n_near) and links between nodes (a, b).

    A node is 128 bits of the vector's hash, so ids may be null or repeat.

    n_near is the number of vectors in other groups that were found at the cosine or above, from either end. links
    hold a spanning forest of each compared block, which reaches what all its links reach.
    Null and zero vectors and those with null or non-finite components are in no group. Vectors are
    compared with those of their own length.
    """
    spark = vectors.sparkSession
    valid = vectors.select(F.col(id).alias("id"), F.col(embedding).alias("v")).where(usable("v"))
    v = F.col("v")
    half = lambda h: F.unhex(F.lpad(F.hex(h), 16, "0"))
    keyed = valid.select("id", F.concat(half(F.xxhash64(v)), half(F.xxhash64(F.lit(3), v))).alias("node"), "v")
    groups = stored(keyed.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    members = keyed.select("id", "node")
    counts, links = None, None
    for (width,) in groups.select(F.size("v")).distinct().collect():  # lengths of vectors: one as a rule
        near, edges = _search(spark, groups.where(F.size("v") == width), width, cosine, recall)
        counts, links = (near, edges) if counts is None else (counts.unionByName(near), links.unionByName(edges))
    if counts is None:
        counts, links = spark.createDataFrame([], "node binary, n long"), spark.createDataFrame([], "a binary, b binary")
    counts = counts.groupBy("node").agg(F.sum("n").alias("n_near"))
    done = groups.drop("v").join(counts, "node", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    return members, done, links


def _search(spark, groups: DataFrame, width: int, cosine: float, recall: float) -> tuple[DataFrame, DataFrame]:
    rows = groups.count()
    taken = _directions(np.array([r[0] for r in groups.orderBy("node").limit(SAMPLE).select("v").collect()], dtype=np.float64))
    k = int(np.clip(round(rows**0.5 / 10), 1, min(LARGEST, len(taken))))
    h = width // 2
    books = (fit_codebook(taken[:, :h], k), fit_codebook(taken[:, h:], k))
    visits = cells_for(taken, books, cosine, recall)
    del taken

    kind = groups.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each vector: first its own, then those it visits."""
        for batch in batches:
            x = _matrix(batch.column(1))
            near = half_distances(x, books)
            own = near[0].argmin(1) * k + near[1].argmin(1)
            seen = [traverse(a, b, visits) for a, b in zip(*near, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(own.astype(np.int32)), pa.array(seen, pa.list_(pa.int32()))], ["node", "copies", "v", "own", "seen"])

    placed = stored(groups.select("node", "v", "copies").mapInArrow(place, f"node binary, copies long, v {kind}, own int, seen array<int>"))
    salt = F.xxhash64("node")
    as_member = placed.select(F.col("own").alias("cell"), F.lit(False).alias("asks"), "node", "copies", "v", "own", "seen")
    as_query = placed.select(F.explode("seen").alias("cell"), F.lit(True).alias("asks"), "node", "copies", "v", "own", F.array().cast("array<int>").alias("seen"))
    # at most LARGEST^2 rows: into how many blocks the members and the queries of a cell are dealt
    cells = as_member.select("cell", "asks").unionByName(as_query.select("cell", "asks")).groupBy("cell").agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("m"))
    blocks = F.broadcast(stored(cells.where("m > 0").select("cell", *[F.ceil(F.greatest(F.col(c), F.lit(1)) / BLOCK).cast("int").alias(c) for c in ("q", "m")])))
    as_member = as_member.join(blocks, "cell").withColumn("mb", F.pmod(salt, "m").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    as_query = as_query.join(blocks, "cell").withColumn("qb", F.pmod(salt, "q").cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = as_member.unionByName(as_query)

    def compare(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"))
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        nodes, copies = t.column("node").to_pylist(), t.column("copies").to_numpy()
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(x, len(number)) for x in nodes])
        qi, mi = np.flatnonzero(asks), np.flatnonzero(~asks)
        own, seen = t.column("own").to_numpy().astype(np.int64), t.column("seen").combine_chunks()
        lengths = pc.list_value_length(seen).to_numpy(zero_copy_only=False)
        visited = np.sort(np.repeat(np.arange(len(ids)), lengths) * (k * k) + pc.list_flatten(seen).to_numpy(zero_copy_only=False))
        n = np.zeros(len(ids), np.int64)
        a, b = [], []
        for s in range(0, len(qi), 512):
            part = qi[s : s + 512]
            hit_q, hit_m = np.nonzero(x[part] @ x[mi].T >= cosine)
            hit_q, hit_m = part[hit_q], mi[hit_m]
            other = ids[hit_q] != ids[hit_m]
            hit_q, hit_m = hit_q[other], hit_m[other]
            np.add.at(n, hit_q, copies[hit_m])
            back = hit_m * (k * k) + own[hit_q]  # where the member asks too, it counts the pair itself
            at = np.searchsorted(visited, back)
            once = visited[np.minimum(at, len(visited) - 1)] != back
            np.add.at(n, hit_m[once], copies[hit_q[once]])
            a.append(hit_q)
            b.append(hit_m)
        a, b = np.concatenate(a or [qi[:0]]), np.concatenate(b or [qi[:0]])
        used = np.unique(np.concatenate((a, b)))
        label = used[forest(np.searchsorted(used, a), np.searchsorted(used, b), len(used))] if len(used) else used
        asked = np.flatnonzero(n)
        rows = np.concatenate((asked, used)).astype(np.int64)
        near = np.concatenate((n[asked], np.zeros(len(used), np.int64)))
        root = np.concatenate((asked, label)).astype(np.int64)
        return pa.table({"node": pa.array([nodes[i] for i in rows], pa.binary()), "n": near, "root": pa.array([nodes[i] for i in root], pa.binary())})

    found = stored(dealt.groupBy("cell", "mb", "qb").applyInArrow(compare, "node binary, n long, root binary"))
    return found.where("n > 0").select("node", "n"), found.where("n = 0 and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def dedup_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.99, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors.

    Rows that share a vec_id count as vectors of their own; a vector that links with nothing is its own
    component; an empty table gives an empty result. component_id is the smallest id of those reached, null where
    none has an id; kept says that vec_id is the component's, which for a null id means that none there has one.
    """
    members, groups, links = near_links(vectors, cosine, recall, id, embedding)
    roots = components(links).withColumnRenamed("node", "linked")
    named = groups.join(roots, F.col("node") == F.col("linked"), "left").select("node", "least", (F.col("n_near") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select("node", "n_links", "component_id")
    found = members.join(known, "node").select("id", "n_links", "component_id")
    alone = vectors.where(~usable(embedding)).select(F.col(id).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id).alias("component_id"))
    every = found.unionByName(alone)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_multi_index(spark, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
