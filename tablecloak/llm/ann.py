"""Approximate nearest neighbours: one small-world graph per shard, shard results merged.

Equal vectors form a class, of which one vector is indexed, so that thousands of copies cannot cut a
graph apart. Classes are dealt to shards of a bounded size by a hash. A shard's graph is a
hierarchy of layers; each layer is one flat array with a fixed number of neighbours per node, -1
where there are fewer. Graphs are built in one task per shard and written to the shared folder, so a
lost executor costs the shards it was building. Every block of queries searches every shard, and
only the best classes of each shard leave its task; a ranking by query merges them. Classes are then
expanded to their smallest ids, of which at most `k + 1` can appear in an answer.

Nearness is the inner product. Graphs need a metric, so within a shard vectors get one more
coordinate that makes their norms equal (nothing changes for unit vectors); scores are computed in
double precision on the original vectors, added up in order of the coordinates.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do those of another dimension than most (ties: the larger); ties of scores go to the smaller id;
of several rows of an id, candidates or queries, only the one
with the smallest vector counts; fewer candidates than `k` give all of them; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecloak.llm.common import Scratch, ship

#: Vectors per shard on average; neighbours per node (twice as many on the ground layer); breadth of
#: the search while building and while answering; queries per block.
SHARD, LINKS, BUILD_WIDTH, SEARCH_WIDTH, BLOCK = 4096, 16, 96, 128, 1024
#: Most tasks that build or search; each then takes several shards, one after another.
TASKS = 20_000


def level_of(count: int, links: int) -> np.ndarray:
    """Top layer of each node: geometric, from a hash of its number, so a rebuild gives the same graph."""
    x = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    share = (x >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
    return (-np.log(np.maximum(share, 1e-12)) / np.log(links)).astype(np.int64)


def beam(data: np.ndarray, layer: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple:
    """Best-first search of many queries at once: ids and distances of up to `width` nodes each, nearest
    first. `entry` holds start nodes by query; -1 marks none."""
    n, m = len(queries), layer.shape[1]
    size = len(data)
    seen = np.zeros((n, size + 1), bool)
    row = np.arange(n)[:, None]

    def distance(nodes: np.ndarray, who: np.ndarray) -> np.ndarray:
        return 1.0 - np.einsum("qd,qmd->qm", queries[who], data[nodes])

    ids = np.full((n, width), size)
    far = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    start = np.where(entry < 0, size, entry)
    k = start.shape[1]
    ids[:, :k] = start
    far[:, :k] = np.where(start < size, distance(np.minimum(start, size - 1), np.arange(n)), np.inf)
    done[:, :k] = start == size
    seen[row, start] = True
    order = np.argsort(far, 1, "stable")
    ids, far, done = (np.take_along_axis(x, order, 1) for x in (ids, far, done))
    active = np.arange(n)
    while len(active):
        open_ = ~done[active]
        has = open_.any(1)
        active, open_ = active[has], open_[has]
        if not len(active):
            break
        at = open_.argmax(1)
        done[active, at] = True
        near = layer[ids[active, at]]
        near = np.where(near < 0, size, near)
        fresh = ~seen[active[:, None], near] & (near < size)
        seen[active[:, None], near] = True
        d = np.where(fresh, distance(np.minimum(near, size - 1), active), np.inf)
        use = (d < far[active, -1:]).any(1)
        if not use.any():
            continue
        who = active[use]
        all_ids = np.concatenate((ids[who], np.where(fresh[use], near[use], size)), 1)
        all_far = np.concatenate((far[who], d[use]), 1)
        all_done = np.concatenate((done[who], ~fresh[use]), 1)
        order = np.argsort(all_far, 1, "stable")[:, :width]
        ids[who], far[who] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_far, order, 1)
        done[who] = np.take_along_axis(all_done, order, 1) | ~np.isfinite(far[who])
    return ids, far


def spread(data: np.ndarray, ids: np.ndarray, far: np.ndarray, keep: int) -> np.ndarray:
    """For each row of candidates, nearest first, up to `keep` that are nearer to the row's node than to
    any chosen before (so links lead into different directions); the nearest others fill up."""
    n, width = ids.shape
    real = np.isfinite(far)
    vectors = data[np.minimum(ids, len(data) - 1)]
    between = 1.0 - np.einsum("nid,njd->nij", vectors, vectors)
    chosen = np.zeros((n, width), bool)
    for i in range(width):
        blocked = (chosen[:, :i] & (between[:, i, :i] < far[:, i:i + 1])).any(1) if i else np.zeros(n, bool)
        chosen[:, i] = real[:, i] & ~blocked & (chosen.sum(1) < keep)
    order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), 1, "stable")[:, :keep]
    out = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(ids, order, 1), -1)
    return out if width >= keep else np.pad(out, ((0, 0), (0, keep - width)), constant_values=-1)


def build(vectors: np.ndarray, links: int, width: int) -> tuple[list[np.ndarray], int]:
    """Layers from the ground up, and the entry node. Nodes enter in growing batches, which are
    searched together in the graph so far; a batch's nodes also see each other."""
    data = level_data(vectors)
    count = len(data)
    level = level_of(count, links)
    level = np.minimum(level, max(0, int(np.log(max(count, 2)) / np.log(links))))
    order = np.argsort(-level, kind="stable")  # upper layers first, so the entry never changes
    layers = [np.full((count, links * (2 if h == 0 else 1)), -1, np.int64) for h in range(int(level.max()) + 1)]
    entry, done = int(order[0]), 1
    while done < count:
        batch = order[done:done + max(1, min(256, done // 2))]
        batch = batch[level[batch] == level[batch[0]]]
        top = int(level[batch[0]])
        start = np.full((len(batch), 1), entry)
        for h in range(len(layers) - 1, -1, -1):
            if h > top:
                start = beam(data, layers[h], data[batch], start, 1)[0]
                continue
            ids, far = beam(data, layers[h], data[batch], np.where(start < count, start, -1), width)
            start = ids[:, :8]
            mutual = 1.0 - data[batch] @ data[batch].T
            np.fill_diagonal(mutual, np.inf)
            mutual[np.triu_indices(len(batch))] = np.inf  # those before it in the batch
            peers = np.argsort(mutual, 1, "stable")[:, :links]
            peer_far = np.take_along_axis(mutual, peers, 1)
            ids = np.concatenate((ids, np.where(np.isfinite(peer_far), batch[peers], count)), 1)
            far = np.concatenate((far, peer_far), 1).astype(np.float32)
            best = np.argsort(far, 1, "stable")[:, :2 * links + 8]
            ids, far = np.take_along_axis(ids, best, 1), np.take_along_axis(far, best, 1)
            chosen = spread(data, ids, far, links)
            layers[h][batch, :links] = chosen
            link_back(data, layers[h], batch, chosen)
        done += len(batch)
    return layers, entry


def link_back(data: np.ndarray, layer: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen neighbours back; a full list keeps a spread choice."""
    source = np.repeat(batch, chosen.shape[1])
    target = chosen.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, at, counts = np.unique(target, return_index=True, return_counts=True)
    most, width = int(counts.max()), layer.shape[1]
    new = np.full((len(nodes), most), -1)
    new[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(at, counts)] = source
    both = np.concatenate((layer[nodes], new), 1)
    full = (both >= 0).sum(1) > width
    easy = nodes[~full]
    order = np.argsort(both[~full] < 0, 1, "stable")[:, :width]
    layer[easy] = np.take_along_axis(both[~full], order, 1)
    for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // 256)):
        if len(part):
            d = 1.0 - np.einsum("nd,nmd->nm", data[nodes[part]], data[both[part]])
            d = np.where(both[part] < 0, np.inf, d)
            order = np.argsort(d, 1, "stable")
            layer[nodes[part]] = spread(data, np.take_along_axis(both[part], order, 1),
                                        np.take_along_axis(d, order, 1), width)


def level_data(vectors: np.ndarray) -> np.ndarray:
    """Vectors of equal norm one: scaled by the largest norm, with a coordinate for what is missing."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    scaled = vectors / norms.max()
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled.astype(np.float64) ** 2).sum(1)))
    return np.concatenate((scaled, rest[:, None]), 1).astype(np.float32)


def search(vectors: np.ndarray, layers: list[np.ndarray], entry: int, queries: np.ndarray, width: int) -> np.ndarray:
    """Nodes found for each query, nearest first; the number of nodes marks none."""
    data = level_data(vectors)
    unit = queries / np.maximum(np.sqrt((queries.astype(np.float64) ** 2).sum(1))[:, None], 1e-300)
    asked = np.concatenate((unit, np.zeros((len(queries), 1))), 1).astype(np.float32)
    start = np.full((len(queries), 1), entry)
    for h in range(len(layers) - 1, 0, -1):
        start = beam(data, layers[h], asked, start, 1)[0]
    return beam(data, layers[0], asked, start, min(width, len(data)))[0]


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products (rows of queries by their rows of vectors), added in order of the coordinates."""
    out = np.zeros(vectors.shape[:2])
    for d in range(queries.shape[1]):
        out += queries[:, d:d + 1].astype(np.float64) * vectors[:, :, d].astype(np.float64)
    return out


def usable(vector: Column) -> Column:
    """No null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20,
            shard: int = SHARD, links: int = LINKS, build_width: int = BUILD_WIDTH,
            search_width: int = SEARCH_WIDTH) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row of `queries` its `k` nearest rows found, without the row
    of the same id. Both frames have integer ids and arrays of floats or doubles."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    plain = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")) \
        .filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = plain(rows).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d")).alias("m"), F.sum("n").alias("total")).first()
    if found.m is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    d, shards = found.m.d, max(1, round(found.total / shard))
    # one row for each id, so that an id belongs to one class and the smallest id names it
    rows_, queries_ = (plain(x).filter(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")) for x in (rows, queries))

    # the smallest ids of each class; the rank limit acts before the shuffle, so a hot class stays small
    in_class = Window.partitionBy("v").orderBy("id")
    best = rows_.withColumn("r", F.row_number().over(in_class)).filter(F.col("r") <= k + 1)
    classes = scratch.keep(best.groupBy("v").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("ids")))
    dealt = classes.select("class", "v", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import ann

        table = pa.Table.from_batches(batches).sort_by("class")
        vectors = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        layers, entry = ann.build(vectors, links, build_width)
        yield pa.RecordBatch.from_pylist([{
            "shard": table["shard"][0].as_py(), "entry": entry, "classes": table["class"].to_numpy().tobytes(),
            "vectors": vectors.tobytes(), "layers": [x.astype("<i4").tobytes() for x in layers]}], schema=shape)

    shape = pa.schema([("shard", pa.int32()), ("entry", pa.int32()), ("classes", pa.binary()),
                       ("vectors", pa.binary()), ("layers", pa.list_(pa.binary()))])
    graphs = scratch.keep(dealt.repartition(min(shards, TASKS), "shard").groupBy("shard").applyInArrow(
        lambda t: pa.Table.from_batches(index(t.to_batches())),
        "shard int, entry int, classes binary, vectors binary, layers array<binary>"))

    # every block of queries meets every shard
    blocks = max(1, -(-queries_.count() // BLOCK))
    asked = queries_.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(ask: pa.Table, graph: pa.Table) -> pa.Table:
        from tablecloak.llm import ann

        if not len(ask) or not len(graph):
            return answers.empty_table()
        g = graph.to_pylist()[0]
        vectors = np.frombuffer(g["vectors"]).reshape(-1, d)
        layers = [np.frombuffer(x, "<i4").reshape(len(vectors), -1).astype(np.int64) for x in g["layers"]]
        classes_ = np.frombuffer(g["classes"], np.int64)
        out = []
        for at in range(0, len(ask), 256):
            part = ask.slice(at, 256)
            q = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
            nodes = ann.search(vectors, layers, g["entry"], q, max(search_width, k + 1))
            real = nodes < len(vectors)
            nodes = np.where(real, nodes, 0)
            score = np.where(real, ann.exact_scores(q, vectors[nodes]), -np.inf)
            found_ = classes_[nodes]
            order = np.lexsort((found_, -score), axis=1)[:, :k + 1]
            real, score, found_ = (np.take_along_axis(x, order, 1) for x in (real, score, found_))
            ids = np.broadcast_to(part["id"].to_numpy()[:, None], real.shape)
            out.append(pa.table([ids[real], found_[real], score[real]], schema=answers))
        return pa.concat_tables(out)

    answers = pa.schema([("query_id", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])
    parts = min(shards * blocks, TASKS)
    asked, pairs = (x.repartition(parts, "shard", "block") for x in (asked, pairs))
    hits = asked.groupBy("shard", "block").cogroup(pairs.groupBy("shard", "block")).applyInArrow(
        answer, "query_id bigint, class bigint, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
    merged = hits.withColumn("r", F.row_number().over(by_query)).filter(F.col("r") <= k + 1)
    expanded = merged.join(classes.select("class", "ids"), "class").select(
        "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = scratch.keep(expanded.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
                       .select("query_id", "rank", "vec_id", "score"))
    scratch.drop(out)
    return out
