"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors are one vertex (with its number of rows). Centroids are fitted on a bounded sample;
   every vertex goes to its nearest centroids, so shards overlap. Shards over ``CAP`` vertices are
   split into parts by hash, and each pair of parts is a shard of its own: nothing is left out.
2. In each shard a graph is built: candidates are the nearest vertices and some far ones, pruned by
   the robust rule (a neighbour is dropped when a kept one is closer to it by a factor), then made
   mutual. The adjacency lists of a vertex in all its shards are united.
3. In each shard every vertex is searched for: best-first from medoids over the united lists, then the
   range is expanded: neighbours of all vertices found near the threshold, until no new one appears.
4. What is found is verified by cosine in double precision; a check of the shard's vectors against each
   other adds what the search missed there, and logs how much. A pair counts in the first shard that
   both of its ends share, so links are counted in shards; only one edge a vertex leaves a shard for
   the components.
5. The mean recall a vertex is audited against brute force at every size, on vertices sampled from all
   and from those with few links; below ``target`` the shards overlap more and the search starts anew.
   If it stays below, every pair of blocks is compared, which is exact and quadratic.
   So the outcome is exact within shards, by the check; a pair whose ends share no shard isn't found, and
   what is lost so is bounded by the audit's sample only, not known.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
link with nothing: n_links 0, component_id is their own id (null for a null id), which they keep.
Vectors of different lengths never link. Repeated rows (same id and vector) link with each other; so
two rows of one id are both kept when they have the smallest id. An empty table gives no rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, prepare, table, written

CAP, SHARD, SAMPLE, MOST_CENTROIDS, DEGREE, CANDIDATES, BEAM = 1500, 800, 20_000, 4096, 24, 48, 24
ALPHA, SLACK = 1.2, 0.06
LOG = logging.getLogger(__name__)
NODES = "vertex long, rows long, shards array<int>, vector array<double>, shard int, i int, j int, part int"


def cosines(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Of rows with rows."""
    return np.einsum("ij,ij->i", x, y) / (nx * ny)


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    c = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T, axis=1) for part in np.array_split(unit, -(-len(unit) // 4096))])
        total = np.zeros_like(c)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def nearest_shards(unit: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    n = min(overlap, len(c))
    similarity = unit @ c.T
    return np.argpartition(-similarity, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(unit), 1))


def build(unit: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Adjacency of a robust-pruned graph over a shard."""
    n = len(unit)
    if n == 1:
        return [np.empty(0, dtype=np.int64)]
    rng, k = np.random.default_rng(seed), min(CANDIDATES, n - 1)
    kept: list[np.ndarray] = []
    far = min(12, n)
    for rows in np.array_split(np.arange(n), -(-n // 256)):
        similarity = unit[rows] @ unit.T
        similarity[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
        cand = np.concatenate([near, rng.integers(0, n, (len(rows), far))], axis=1)
        own = np.take_along_axis(similarity, cand, 1)
        own[own == -np.inf] = -2.0
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        distance = np.sqrt(np.maximum(0, 2 - 2 * own))
        x = unit[cand]
        among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qid,qjd->qij", x, x)))
        alive = own > -2.0
        chosen = np.zeros(cand.shape, dtype=bool)
        for _ in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = np.argmax(alive, axis=1)
            chosen[np.flatnonzero(some), first[some]] = True
            covered = ALPHA * among[np.arange(len(rows)), first] <= distance
            alive &= ~covered
            alive[np.arange(len(rows)), first] = False
        # the nearest few stay: they carry the expansion of ranges
        chosen[:, : min(6, k)] |= own[:, : min(6, k)] > -2.0
        kept += [c[m] for c, m in zip(cand, chosen)]
    src = np.repeat(np.arange(n), [len(x) for x in kept])
    dst = np.concatenate(kept)
    code = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    a, b = code // n, code % n
    a, b = a[a != b], b[a != b]
    return np.split(b, np.cumsum(np.bincount(a, minlength=n))[:-1])


def _matrix(adjacency: list[np.ndarray]) -> np.ndarray:
    matrix = np.zeros((len(adjacency), len(adjacency)), dtype=np.float32)
    for i, a in enumerate(adjacency):
        matrix[i, a] = 1
    return matrix


def checked(vectors: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs i < j that a search found, those of the shard that it missed, and how many these are.

    So a pair counts in the first shard that both its ends share, whatever the search found there.
    """
    n, norm = len(vectors), np.linalg.norm(vectors, axis=1)
    unit, codes = vectors / norm[:, None], [i.astype(np.int64) * n + j]
    for rows in np.array_split(np.arange(n), -(-n // 512)):
        a, b = np.nonzero(unit[rows] @ unit.T >= threshold - 1e-9)
        a = rows[a]
        a, b = a[a < b], b[a < b]
        for part in range(0, len(a), 100_000):
            x, y = a[part : part + 100_000], b[part : part + 100_000]
            codes.append((x * n + y)[cosines(vectors[x], vectors[y], norm[x], norm[y]) >= threshold])
    code = np.unique(np.concatenate(codes))
    return code // n, code % n, len(code) - len(i)


def search(vectors: np.ndarray, adjacency: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j with cosine >= threshold that are found."""
    n, norm = len(vectors), np.linalg.norm(vectors, axis=1)
    width = max(1, max(len(a) for a in adjacency))
    lists = np.full((n, width), -1, dtype=np.int32)
    for i, a in enumerate(adjacency):
        lists[i, : len(a)] = a
    unit = vectors / norm[:, None]
    # medoids: the vertex nearest to the mean, and that nearest to the mean of what it is far from
    middle = int(np.argmax(unit @ unit.mean(axis=0)))
    medoids = [middle]
    for _ in range(min(7, n - 1)):
        rest = np.max(unit @ unit[medoids].T, axis=1)
        medoids.append(int(np.argmin(rest)))
    medoids = np.unique(medoids)
    found, matrix = [], None
    for queries in np.array_split(np.arange(n), -(-n // 256)):
        q = len(queries)
        at = np.arange(q)
        value = np.full((q, n), -2.0)
        todo = np.zeros((q, n), dtype=bool)  # seen, not expanded

        def see(rows: np.ndarray, nodes: np.ndarray, value=value, todo=todo, queries=queries) -> None:
            for s in range(0, len(rows), 100_000):
                r, v = rows[s : s + 100_000], nodes[s : s + 100_000]
                value[r, v] = cosines(vectors[queries[r]], vectors[v], norm[queries[r]], norm[v])
            todo[rows, nodes] = True

        see(np.repeat(at, len(medoids)), np.tile(medoids, q))
        for _ in range(BEAM):
            best = np.argmax(np.where(todo, value, -3.0), axis=1)
            live = todo[at, best]
            if not live.any():
                break
            todo[at[live], best[live]] = False
            next_ = lists[best[live]]
            rows = np.repeat(at[live], width)
            nodes = next_.ravel()
            ok = nodes >= 0
            rows, nodes = rows[ok], nodes[ok]
            new = value[rows, nodes] == -2.0
            see(rows[new], nodes[new])
        while True:
            near = todo & (value >= threshold - SLACK)
            if not near.any():
                break
            todo &= ~near
            rows, nodes = np.nonzero(near)
            if len(rows) * width < q * n:
                to = lists[nodes]
                code = np.unique((np.repeat(rows, width) * n + to.ravel())[to.ravel() >= 0])
                rows, nodes = code // n, code % n
                new = value[rows, nodes] == -2.0
                see(rows[new], nodes[new])
            else:  # a dense group: by a product
                matrix = _matrix(adjacency) if matrix is None else matrix
                see(*np.nonzero(((near.astype(np.float32) @ matrix) > 0) & (value == -2.0)))
        r, v = np.nonzero(value >= threshold)
        i, j = queries[r], v
        found.append(np.unique((np.minimum(i, j) * n + np.maximum(i, j))[i != j]))
    code = np.unique(np.concatenate(found))
    return code // n, code % n


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(frame["vector"].to_numpy())
    ids = frame["vertex"].to_numpy()
    lists = build(x / np.linalg.norm(x, axis=1, keepdims=True))
    return pd.DataFrame({"vertex": ids, "neighbours": [ids[a] for a in lists]})


def _search_shard(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vertex", ignore_index=True)
        ids, n = frame["vertex"].to_numpy(), len(frame)
        x = np.stack(frame["vector"].to_numpy())
        lists = []
        for own in frame["neighbours"]:
            a = np.searchsorted(ids, own)
            a = a[(a < n) & (ids[np.minimum(a, n - 1)] == own)]
            lists.append(a)
        i, j, missed = checked(x, *search(x, lists, threshold), threshold)
        # the pair counts here if this is the first shard both share, and in this pair of parts
        shard, part = int(frame["shard"].iloc[0]), frame["part"].to_numpy()
        parts = (int(frame["i"].iloc[0]), int(frame["j"].iloc[0]))
        shards = frame["shards"].tolist()
        first = np.array([min(set(shards[a]) & set(shards[b])) == shard for a, b in zip(i, j)], dtype=bool)
        counts = first & (np.minimum(part[i], part[j]) == parts[0]) & (np.maximum(part[i], part[j]) == parts[1])
        rows, links = frame["rows"].to_numpy(), np.zeros(n, dtype=np.int64)
        np.add.at(links, i[counts], rows[j[counts]])
        np.add.at(links, j[counts], rows[i[counts]])
        return pd.DataFrame({"vertex": ids, "links": links, "root": ids[roots(n, i, j)], "missed": [missed] + [0] * (n - 1), "pairs": [len(i)] + [0] * (n - 1)})

    return run


def _sharded(vertices: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """NODES: a row for each vertex and (part of a) shard that it is in."""
    shared = vertices.sparkSession.sparkContext.broadcast(c)

    def assign(frames):
        for frame in frames:
            if len(frame):
                x = np.stack(frame["vector"].to_numpy())
                shards = nearest_shards(x / np.linalg.norm(x, axis=1, keepdims=True), shared.value, overlap)
                yield frame.assign(shards=[np.sort(s).astype(np.int32) for s in shards])[["vertex", "rows", "shards", "vector"]]

    assigned = written(vertices.mapInPandas(assign, "vertex long, rows long, shards array<int>, vector array<double>"), "assigned")
    each = assigned.withColumn("shard", F.explode("shards"))
    sizes = each.groupBy("shard").agg(F.ceil(F.count("*") / CAP).cast("int").alias("parts"))  # a row a centroid
    each = each.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("vertex", "shard"), F.col("parts")).cast("int"))
    other = each.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.select("vertex", "rows", "shards", "vector", "shard", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part")


def audit(vertices: DataFrame, links: DataFrame, threshold: float, queries: int = 200) -> float:
    """Mean recall of sampled vertices: of each that has links by brute force, the share that ``links`` has.

    Half are drawn from all vertices, half from those that ``links`` gives no more links than the median.
    """
    known = vertices.join(links, "vertex", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    drawn = known.orderBy(F.xxhash64("vertex")).limit(queries // 2)
    median = known.agg(F.percentile_approx("links", 0.5)).first()[0]
    few = known.where(F.col("links") <= F.lit(median or 0)).orderBy(F.xxhash64("vertex", F.lit(1))).limit(queries // 2)
    sample = drawn.union(few).dropDuplicates(["vertex"]).toPandas()
    if not len(sample):
        return 1.0
    true = sample[["vertex", "links"]].merge(_exact(vertices, sample, threshold), on="vertex")
    true = true[true["true"] > 0]
    return float(np.minimum(1, true["links"] / true["true"]).mean()) if len(true) else 1.0


def _exact(vertices: DataFrame, sample: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """vertex, true: links of a bounded number of vertices by brute force in blocks."""
    ids, q = sample["vertex"].to_numpy(), np.stack(sample["vector"].to_numpy())
    shared = vertices.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

    def count(frames):
        names, unit = shared.value
        total = np.zeros(len(names), dtype=np.int64)
        for frame in frames:
            if len(frame):
                x = np.stack(frame["vector"].to_numpy())
                hit = unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= threshold
                hit &= names[:, None] != frame["vertex"].to_numpy()[None, :]
                total += hit @ frame["rows"].to_numpy()
        yield pd.DataFrame({"vertex": names, "true": total})

    return vertices.mapInPandas(count, "vertex long, true long").groupBy("vertex").agg(F.sum("true").alias("true")).toPandas()


def _every_pair(vertices: DataFrame, threshold: float) -> DataFrame:
    """vertex, links, root by an exact search: every pair of blocks of at most about ``CAP`` vertices is compared."""
    blocks = -(-vertices.count() // CAP)
    each = vertices.withColumn("part", F.pmod(F.xxhash64("vertex"), F.lit(blocks)).cast("int"))
    each = each.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = each.select("vertex", "rows", "vector", "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vertex", ignore_index=True)
        x, part, n = np.stack(frame["vector"].to_numpy()), frame["part"].to_numpy(), len(frame)
        norm = np.linalg.norm(x, axis=1)
        unit, within = x / norm[:, None], frame["i"].iloc[0] == frame["j"].iloc[0]
        near = np.triu(unit @ unit.T >= threshold - 1e-9, 1)
        i, j = np.nonzero(near if within else near & (part[:, None] != part[None, :]))
        exact = np.concatenate([cosines(x[a], x[b], norm[a], norm[b]) >= threshold for a, b in zip(*(np.array_split(v, -(-max(1, len(i)) // 100_000)) for v in (i, j)))])
        i, j = i[exact], j[exact]
        rows, links = frame["rows"].to_numpy(), np.zeros(n, dtype=np.int64)
        np.add.at(links, i, rows[j])
        np.add.at(links, j, rows[i])
        return pd.DataFrame({"vertex": frame["vertex"], "links": links, "root": frame["vertex"].to_numpy()[roots(n, i, j)]})

    return written(pairs.groupBy("i", "j").applyInPandas(compare, "vertex long, links long, root long"), "found")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.9, target: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0)
    # squares of very large or small components leave the range of a double; a cosine doesn't change by a factor
    most = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    scaled = F.when((most > 1e100) | (most < 1e-100), F.transform("vector", lambda v: v / most)).otherwise(F.col("vector"))
    rows = rows.withColumn("vector", F.when(usable, scaled))
    vertices = written(rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least")).withColumn("vertex", F.monotonically_increasing_id()), "vertices")
    lengths = [r[0] for r in vertices.select(F.size("vector")).distinct().collect()]
    parts = [_linked(vertices.where(F.size("vector") == n).select("vertex", "rows", "vector"), threshold, target) for n in sorted(lengths)]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)

    label = components(found.where("vertex <> root").select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vertex").agg(F.sum("links").alias("links"))
    named = vertices.join(label.withColumnRenamed("id", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    outcome = named.join(least, "component").join(links, "vertex", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    joined = rows.join(outcome, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _linked(vertices: DataFrame, threshold: float, target: float) -> DataFrame:
    """vertex, links, root of vertices of one length."""
    n = vertices.count()
    sample = vertices.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()
    c = centroids(np.stack(sample["vector"].to_numpy()), min(MOST_CENTROIDS, max(1, n // SHARD)))
    found = None
    for overlap in (3, 6, 12):
        nodes = written(_sharded(vertices, c, overlap), "nodes")
        key = ["shard", "i", "j"]
        lists = nodes.groupBy(*key).applyInPandas(_build_shard, "vertex long, neighbours array<long>")
        united = lists.groupBy("vertex").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
        joined = nodes.join(united, "vertex")
        found = written(joined.groupBy(*key).applyInPandas(_search_shard(threshold), "vertex long, links long, root long, missed long, pairs long"), "found")
        within = found.agg(F.sum("missed"), F.sum("pairs")).first()
        found = found.drop("missed", "pairs")
        recall = audit(vertices, found.groupBy("vertex").agg(F.sum("links").alias("links")), threshold)
        LOG.info("overlap %d: recall a vertex %.4f; the search missed %d of %d pairs within shards, which were added", overlap, recall, *within)
        if recall >= target:
            return found
        if overlap >= len(c):
            break  # every vertex is in every shard
    return _every_pair(vertices, threshold)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLE_SQL: dict[str, str] = {}
