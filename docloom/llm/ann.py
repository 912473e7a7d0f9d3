"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of like size with few edges between them; a small network learns to
tell a vector's part; every row is put in its likeliest part, and a query is sent to its likeliest few, where all rows are
compared exactly. The number of parts searched is set on held-out rows of the sample, against brute force. Parts that hold many rows
are cut in the same way once more, each by a graph and a network of its own, so that the number of parts grows with the rows and a
query meets a like number of rows in each. Every table is searched so; one of fewer than 64 vectors is one part.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, stash, table

#: Bounds of the sample that an index, or the index of one part, is fitted on: rows, and numbers in all their vectors.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 24
#: Rows of a part that one group of a task holds; larger parts are cut, and queries go to each piece.
PIECE = 8192
#: Rows that a task routes within a part.
ROUTED = 1 << 16
#: Rows aimed at in a part; parts at least; rows of the sample for each part at least.
PART_ROWS, LEAST_PARTS, PART_SAMPLE = 2048, 8, 32
#: Recall aimed at on held-out rows of the sample, in each of the two levels.
TARGET_RECALL = 0.985
NEIGHBOURS = 10


def usable(v: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS, to: np.ndarray | None = None) -> np.ndarray:
    """(rows, k): for each row of ``x`` its nearest rows of ``to``; without ``to``, its nearest others."""
    own = to is None
    to = x if own else to
    k = min(k, len(to) - own)
    sq = (to * to).sum(axis=1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    if k <= 0:
        return out
    for s in range(0, len(x), 256):  # the driver holds distances of so many rows at once
        d = sq[None, :] - 2 * x[s : s + 256] @ to.T
        if own:
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.argsort(d, axis=1)
        out[s : s + 256] = near
    return out


def balanced_parts(graph: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.1, seed: int = 1) -> np.ndarray:
    """A part for each node: parts grow from a seed along the most edges up to the common size, then nodes move where more
    of their neighbours are, as long as the part they go to has room."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    near: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            near[i].append(j)
            near[j].append(i)
    part = [-1] * n
    room = -(-n // parts)
    order = iter(rng.permutation(n).tolist())
    for p in range(parts):
        size, pull, queue = 0, {}, []
        while size < room:
            node = -1
            while queue:
                pulled, c = heapq.heappop(queue)
                if part[c] < 0 and pull.get(c) == -pulled:
                    node = c
                    break
            if node < 0:
                node = next((i for i in order if part[i] < 0), -1)
                if node < 0:
                    break
            part[node] = p
            size += 1
            for j in near[node]:
                if part[j] < 0:
                    pull[j] = pull.get(j, 0) + 1
                    heapq.heappush(queue, (-pull[j], j))
    sizes, most = np.bincount(part, minlength=parts).tolist(), int(room * slack) + 1
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes: dict[int, int] = {}
            for j in near[i]:
                votes[part[j]] = votes.get(part[j], 0) + 1
            here = votes.get(part[i], 0)
            best = max(votes, key=lambda p: (votes[p], -p), default=part[i])
            if votes.get(best, 0) > here and sizes[best] < most:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return np.array(part)


@dataclass
class Router:
    """A network of one hidden layer over a unit vector and its length; gives each part's log probability (up to a constant)."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, shares: np.ndarray, hidden: int = 128, epochs: int = 24, batch: int = 256, rate: float = 3e-3, seed: int = 2) -> Router:
    """Fit to ``shares``: for each row, how its neighbours are shared among the parts. Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], shares.shape[1]
    mean = x.mean(axis=0)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) or 1.0
    z = (x - mean) / scale
    theta = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta], 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            h = np.maximum(z[at] @ theta[0] + theta[1], 0)
            o = h @ theta[2] + theta[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            g = (o / o.sum(axis=1, keepdims=True) - shares[at]) / len(at)
            gh = (g @ theta[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((z[at].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                theta[i] = theta[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *theta)


def parts_for(rows: int, sample: int) -> int:
    """Parts of ``rows`` vectors that a sample of so many can tell apart."""
    return int(np.clip(max(rows // PART_ROWS, LEAST_PARTS), 1, max(1, min(rows, sample) // PART_SAMPLE)))


def fit(sample: np.ndarray, parts: int, k: int = 10, target: float = TARGET_RECALL) -> Router:
    """A router to ``parts`` parts. An eighth of the sample is held out to set the number of parts searched: their true neighbours
    are those in the rest of the sample."""
    if parts == 1:
        d = sample.shape[1]
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    held = max(1, len(sample) // 8)
    own, out = sample[held:], sample[:held]
    graph = neighbour_graph(own)
    part = balanced_parts(graph, parts)
    shares = np.zeros((len(own), parts))
    shares[np.arange(len(own)), part] += 1
    for j in range(graph.shape[1]):
        shares[np.arange(len(own)), part[graph[:, j]]] += 1
    router = train_router(own, shares / shares.sum(axis=1, keepdims=True))
    # Rows lie where the router puts them: recall is measured on its own assignment.
    lie = router.logits(own).argmax(axis=1)
    near = lie[neighbour_graph(out, k, own)]
    rank = np.argsort(np.argsort(-router.logits(out), axis=1), axis=1)
    needed = np.take_along_axis(rank, near, axis=1)
    recall = [(needed < p).mean() for p in range(1, parts + 1)]
    router.probes = next((p + 1 for p, r in enumerate(recall) if r >= target), parts)
    return router


def bound_of(length: int, sample: int = SAMPLE) -> int:
    return max(64, min(sample, SAMPLE_NUMBERS // length))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def routed(vectors: DataFrame, router: Router, probes: int) -> DataFrame:
    """``vectors(id, v)`` with ``parts``: the ``probes`` likeliest, likeliest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-router.logits(_matrix(batch.column("v"))), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order), pa.list_(pa.int32()))], names=["id", "v", "parts"])

    return vectors.mapInArrow(run, f"id long, v {vectors.schema['v'].dataType.simpleString()}, parts array<int>")


def _stretches(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Neighbouring rows that agree in the columns, with their values."""
    if batch.num_rows:
        keys = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            yield tuple(keys[s].tolist()), batch.slice(s, e - s)


def _fit_parts(batches: Iterator[pa.RecordBatch], k: int, sizes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A router for each part from its sample; rows come sorted by part."""
    now, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held)
        router = fit(x, parts_for(sizes[now], len(x)), k)
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(router)], pa.binary())], names=["part", "router"])

    for batch in batches:
        for (part,), rows in _stretches(batch, ("part",)):
            if held and part != now:
                yield from made()
                held = []
            now = part
            held.append(_matrix(rows.column("v")))
    if held:
        yield from made()


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and piece, its router first: each base row gets its likeliest part within the part, each query several."""
    now, router = None, None
    for batch in batches:
        for (part, piece, kind), rows in _stretches(batch, ("part", "piece", "kind")):
            if (part, piece) != now:
                now, router = (part, piece), None
            if kind == 0:
                router = pickle.loads(rows.column("router")[0].as_py())
                continue
            subs = np.zeros((rows.num_rows, 1), np.int32)
            if router is not None:
                subs = np.argsort(-router.logits(_matrix(rows.column("v"))), axis=1, kind="stable")[:, : router.probes if kind == 2 else 1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("part", "kind", "id", "v")], pa.array(list(subs), pa.list_(pa.int32()))], names=["part", "kind", "id", "v", "subs"])


def within_parts(base: DataFrame, queries: DataFrame, length: int, k: int, sample: int = SAMPLE) -> DataFrame:
    """``part, sub, asks, id, v``: ``base(part, id, v)`` and ``queries(part, id, v)`` routed within their parts. Parts of less than twice
    ``PART_ROWS`` rows are not cut again. There are ``SAMPLE / PART_SAMPLE`` parts at most, so the driver may count them."""
    sizes = {r["part"]: r["count"] for r in base.groupBy("part").count().collect() if r["count"] >= 2 * PART_ROWS}
    both = base.select("part", F.lit(1).alias("kind"), "id", "v").unionByName(queries.select("part", F.lit(2).alias("kind"), "id", "v"))
    if not sizes:
        return both.select("part", F.lit(0).alias("sub"), (F.col("kind") - 1).alias("asks"), "id", "v")
    bound, spark = bound_of(length, sample), base.sparkSession
    counts = spark.createDataFrame([(p, n, -(-n // ROUTED), min(1.0, bound / n)) for p, n in sorted(sizes.items())], "part int, n long, pieces int, share double")
    few = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    chosen = base.join(F.broadcast(counts), "part").where(few).select("part", "v").repartition("part").sortWithinPartitions("part")
    routers = stash(chosen.mapInArrow(lambda it: _fit_parts(it, k, sizes), "part int, router binary"), "routers")
    kind = base.schema["v"].dataType.simpleString()
    sent = routers.join(F.broadcast(counts), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(None).cast(kind).alias("v"), "router")
    rows = both.join(F.broadcast(counts), "part", "left").select("part", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"), "kind", "id", "v", F.lit(None).cast("binary").alias("router"))
    dealt = rows.unionByName(sent).repartition("part", "piece").sortWithinPartitions("part", "piece", "kind")
    out = dealt.mapInArrow(_route, f"part int, kind int, id long, v {kind}, subs array<int>")
    return out.select("part", F.explode("subs").alias("sub"), (F.col("kind") - 1).alias("asks"), "id", "v")


def nearest_in(base: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of its ``k`` nearest of ``base``, ties to the smaller id."""
    d = (base * base).sum(axis=1)[None, :] - 2 * queries @ base.T + (queries * queries).sum(axis=1)[:, None]
    out = []
    for i, q in enumerate(queries):
        at = np.arange(len(base))
        if len(base) > k:
            kth = np.partition(d[i], k - 1)[k - 1]
            at = np.flatnonzero(d[i] <= kth + 1e-9 * (1 + abs(kth)) * (1 + float(q @ q)))
        exact = np.sqrt(np.cumsum((base[at] - q) ** 2, axis=1)[:, -1])  # added one after another, as SQL adds
        order = np.lexsort((ids[at], exact))[:k]
        out.append((ids[at][order], exact[order]))
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by piece, base rows first: a piece's base rows are held, its queries pass by."""
    now, base, ids, built = None, [], [], None
    for batch in batches:
        for (*key, asks), rows in _stretches(batch, ("part", "sub", "piece", "asks")):
            x, own = _matrix(rows.column("v")), rows.column("id").to_numpy()
            if key != now:
                now, base, ids, built = key, [], [], None
            if not asks:
                base.append(x)
                ids.append(own)
            elif base:
                built = built or (np.concatenate(base), np.concatenate(ids))
                for a in range(0, len(x), 256):
                    found = nearest_in(*built, x[a : a + 256], k)
                    q = np.repeat(own[a : a + 256], [len(f[0]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["q", "id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row of ``vectors(vec_id, embedding)`` its ``k`` nearest others found.

    Unusable vectors (see ``usable``) and rows without a vec_id take no part; vectors of another length have no distance, so those of
    each length are searched by themselves. Equal vectors are searched as one, with their ``k + 1`` smallest ids, so that copies cost
    nothing and none is lost; repeated rows are one row; ties go to the smaller vec_id. Vectors of any length are taken whole; other
    columns, whatever their names, are ignored. An empty table gives no rows.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = [r["d"] for r in own.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = None
    for d in lengths:
        found = _search_length(own.where(F.size("v") == d), is_query, d, k, sample)
        out = found if out is None else out.unionByName(found)
    return out


def _search_length(own: DataFrame, is_query: Column, length: int, k: int, sample: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    copies = stash(own.distinct().withColumn("n", turn).where(F.col("n") <= k + 1), "copies")
    first = copies.where("n = 1").select("id", "v")
    rows = first.count()
    bound = bound_of(length, sample)
    chosen = first.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, bound / rows) * (1 << 30))) if rows > bound else first
    got = chosen.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(bound).select("v").toPandas()["v"].to_list()
    if not got:
        got = [r["v"] for r in first.limit(bound).collect()]
    router = fit(np.stack(got).astype(np.float64), parts_for(rows, len(got)), k)

    asked = own.distinct().where(is_query).select(F.col("id").alias("query_id"), "v").join(first.withColumnRenamed("id", "rep"), "v").select("query_id", "rep")
    asked = stash(asked, "asked")
    base = stash(routed(first, router, 1).select("id", "v", F.get("parts", F.lit(0)).alias("part")), "base")
    queries = first.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    queries = routed(queries, router, router.probes).select(F.explode("parts").alias("part"), "id", "v")
    both = stash(within_parts(base, queries, length, k, sample), "routed")
    discard(base)
    counts = both.where("asks = 0").groupBy("part", "sub").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    met = both.join(counts, ["part", "sub"])
    own_piece = F.array(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    piece = F.explode(F.when(F.col("asks") == 0, own_piece).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))).alias("piece")
    dealt = met.select("part", "sub", piece, "asks", "id", "v").repartition("part", "sub", "piece").sortWithinPartitions("part", "sub", "piece", "asks", "id")
    found = dealt.mapInArrow(lambda it: _search(it, k + 1), "q long, id long, score double")
    best = Window.partitionBy("q").orderBy("score", "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", F.col("id").alias("rep_id"), "score")
    # Back from distinct vectors to rows: of each, the k + 1 smallest ids, for each query row but itself.
    same = Window.partitionBy("q").orderBy("score", "vec_id")
    met = copies.join(first.withColumnRenamed("id", "rep_id"), "v").select("rep_id", F.col("id").alias("vec_id")).join(found, "rep_id")
    met = met.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    out = asked.join(met, F.col("rep") == F.col("q")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
