"""Largest inner products by pruned directed graphs, one graph a shard.

Vectors are dealt by a hash of their id to shards of bounded size, and every row is indexed. A shard's graph
is built in batches of growing size. For every new vector a greedy beam search of the graph so far, and
the other vectors of its batch, propose neighbours. Of them robust pruning keeps the nearest, drops all that
are nearer to it than to the new vector by a factor ``relax``, and goes on with the next; so the edges
point in different directions, some of them far. Edges back are pruned likewise where a node has too many,
and nodes that this cuts off get an edge from the nearest node that can be reached.

Inner products become distances by one more coordinate that gives all vectors of a shard the same length.
A node has room for half as many edges again while the graph grows, and is pruned when that is full.

Equal vectors of a shard are one node with the list of their ids, so a vector that a third of the rows
share is no crowd that the search can be lost in, and ties are settled exactly within it.

A search sends every query to every shard, walks the graph with a beam for many queries at once, and the
best of all shards are merged. A step of a walk looks at the links of several of the best nodes of the beam, and ends
like a walk node by node when all of the beam are looked at. A beam is a row of integers, product and node in one.
Walks compare in single precision; what may be among the best is compared again.
How wide the beam must be depends on the data, so it is measured: on some
vectors of the shard the beam is doubled, from ``beam`` on, until it finds the share ``recall`` of what
comparing all finds. Shards hold up to ``shard_bytes``, and queries meet a shard in blocks, so the memory of
a task is bounded; the number of shards is ``shards`` until they would be larger.

The index is a table: dimension, shard, node, vector, ids, links. Scores are sums of products in double
precision in the order of the components, on the vectors as given, and do not depend on shard or batch.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without
an id take no part; vectors are compared with those of the same dimension; an id counts once, with the
smallest of its vectors (repeated rows are one); queries are no candidates of their own;
with fewer candidates than asked all are given if the graph reaches them; empty tables give no rows;
other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

SHARDS, SHARD_BYTES, BLOCK = 16, 1 << 25, 50_000
DEGREE, WIDTH, RELAX, BEAM, RECALL = 28, 48, 1.2, 64, 0.96
BATCH, CELLS, TRIED = 256, 1 << 22, 64
STEP, NONE = 1 << 15, np.iinfo(np.int64).min


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate that makes all as long as the longest, scaled to length 1."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    most = norms.max()
    return np.hstack([vectors, np.sqrt(np.maximum(most - norms, 0))[:, None]]) / np.sqrt(most)


def coded(scores: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Score and node as one integer that sorts by the score; its last bit says that the node is not looked at yet."""
    bits = np.ascontiguousarray(scores, np.float32).view(np.int32)
    return ((bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | (nodes.astype(np.int64) << 1) | 1


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, score) of the codes; -1 and minus infinity for ``NONE``."""
    bits = (codes >> 32).astype(np.int32)
    scores = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.float32)
    return np.where(codes > NONE, (codes & 0xFFFFFFFF) >> 1, -1), np.where(codes > NONE, scores, np.float32(-np.inf))


def _products(points: np.ndarray, queries: np.ndarray, nodes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Products of each query with its nodes; ``more`` says how many of ``nodes`` are of each query in turn."""
    out, near = np.empty(len(nodes), points.dtype), np.empty((int(more.max(initial=0)), points.shape[1]), points.dtype)
    up = 0
    for query, n in zip(queries, more.tolist(), strict=True):
        low, up = up, up + n
        np.dot(points.take(nodes[low:up], axis=0, out=near[:n], mode="clip"), query, out=out[low:up])
    return out


def walked(points: np.ndarray, links: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int, less: float = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy beam search of several queries at once from the entries: (nodes in the beam, their products minus ``less``, nodes visited), -1 where there are fewer."""
    n, size, degree = len(queries), len(points), links.shape[1]
    at_once = max(1, min(width // 8, 8 + width // 32, 1024))
    most = max(1, min(max(16, STEP // (at_once * degree)), 8 * CELLS // size))
    if n > most:
        parts = [walked(points, links, entries, queries[i : i + most], width, less) for i in range(0, n, most)]
        steps = max(p[2].shape[1] for p in parts)
        path = [np.pad(p[2], ((0, 0), (0, steps - p[2].shape[1])), constant_values=-1) for p in parts]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(path)
    entries = entries[:width]
    beam = np.full((n, width), NONE)
    beam[:, : len(entries)] = coded(queries @ points[entries].T - less, entries)
    seen = np.zeros((n, size), np.int16 if at_once * degree < 1 << 15 else np.int32)  # not 0: where in a step the node was met
    seen[:, entries] = 1
    seen = seen.ravel()
    ended, path, rows = beam.copy(), [], np.arange(n)
    while True:
        fresh = np.where(beam & 1, beam, NONE)
        live = fresh.max(axis=1) > NONE
        if live.sum() <= 0.9 * len(rows):
            ended[rows[~live]] = beam[~live]
            rows, beam, fresh = rows[live], beam[live], fresh[live]
        m = len(rows)
        if not m:
            break
        pick = np.partition(fresh, width - at_once, axis=1)[:, width - at_once :]
        beam -= (beam & 1) * (beam >= pick.min(axis=1)[:, None])
        now = decoded(pick)[0]
        visited = np.full((n, at_once), -1, np.int32)
        visited[rows] = now
        path.append(visited)
        near = links.take(now, axis=0, mode="wrap")
        near[now < 0] = -1
        wide = at_once * degree
        near = near.reshape(m, wide)
        flat = ((rows * size)[:, None] + near).ravel()
        near = near.ravel()
        k = np.flatnonzero((near >= 0) & (seen.take(flat, mode="wrap") == 0))
        flat, r = flat.take(k), k // wide
        place = (k - r * wide + 1).astype(seen.dtype)
        seen[flat] = place
        first = seen.take(flat) == place  # a node that several links lead to counts once
        r, found = r[first], near.take(k[first])
        code = coded(_products(points, queries[rows], found, np.bincount(r, minlength=m)) - less, found)
        good = code > beam.min(axis=1).take(r)
        r, code = r[good], code[good]
        more = np.bincount(r, minlength=m)
        total = width + int(more.max())
        every = np.full((m, total), NONE)
        every[:, :width] = beam
        every[r, width + np.arange(len(r)) - np.repeat(np.cumsum(more) - more, more)] = code
        beam = np.partition(every, total - width, axis=1)[:, total - width :]
    return *decoded(ended), np.concatenate(path, axis=1)


def pruned(points: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Neighbours of the nodes ``own`` among the proposed ones (-1: none), at most ``degree`` each."""
    wide = proposed.shape[1]
    if len(own) > (step := max(1, CELLS // wide**2)):
        return np.concatenate([pruned(points, own[i : i + step], proposed[i : i + step], degree, relax) for i in range(0, len(own), step)])
    near = points[proposed]
    close = (near @ points[own][:, :, None])[:, :, 0]
    close[(proposed < 0) | (proposed == own[:, None])] = -np.inf
    if wide > (some := 2 * degree + 8):  # the nearest come first, so the others matter only where these do not suffice
        pick = np.argpartition(-close, some - 1, axis=1)[:, :some]
        out = _spread(np.take_along_axis(near, pick[:, :, None], 1), np.take_along_axis(close, pick, 1), np.take_along_axis(proposed, pick, 1), degree, relax)
        again = (out[:, -1] < 0) & ((close > -np.inf).sum(axis=1) > some)
        if again.any():
            out[again] = _spread(near[again], close[again], proposed[again], degree, relax)
        return out
    return _spread(near, close, proposed, degree, relax)


def _spread(near: np.ndarray, close: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """The nearest of the proposed nodes (vectors ``near``, products ``close``), then the nearest that none of those hides, and so on."""
    between = near @ near.transpose(0, 2, 1)
    hides = 1 - (1 - close) / (relax * relax)  # a neighbour hides what is at least this close to it
    out = np.full((len(proposed), degree), -1, np.int32)
    rows = np.arange(len(proposed))
    for k in range(degree):
        pick = close.argmax(axis=1)
        live = close[rows, pick] > -np.inf
        if not live.any():
            break
        out[:, k] = np.where(live, proposed[rows, pick], -1)
        np.copyto(close, -np.inf, where=between[rows, pick] >= hides)
        close[rows, pick] = -np.inf
    return out


def _linked_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, degree: int, relax: float) -> None:
    """Add the edges back to the nodes ``new``; prune to ``degree`` where a node has no room for them."""
    room = links.shape[1]
    source = np.repeat(new, room)
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (links[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, more = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(first, more)
    had = (links[nodes] >= 0).sum(axis=1)
    column = np.repeat(had, more) + nth
    fits = np.repeat(had + more <= room, more)
    links[target[fits], column[fits]] = source[fits]
    full = np.flatnonzero(had + more > room)
    full = full[np.argsort(more[full], kind="stable")]
    for at in range(0, len(full), BATCH):
        part = full[at : at + BATCH]
        place = np.full(len(nodes), -1)
        place[part] = np.arange(len(part))
        row = np.repeat(place, more)
        proposed = np.full((len(part), room + int(more[part].max())), -1, np.int32)
        proposed[:, :room] = links[nodes[part]]
        proposed[row[row >= 0], column[row >= 0]] = source[row >= 0]
        links[nodes[part], :degree] = pruned(points, nodes[part], proposed, degree, relax)
        links[nodes[part], degree:] = -1


def built(points: np.ndarray, degree: int = DEGREE, width: int = WIDTH, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Links of every node (-1 where there are fewer than ``degree``) and the node where searches enter."""
    n = len(points)
    links = np.full((n, degree + degree // 2), -1, np.int32)
    entry = int((points @ points.mean(axis=0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    rough = points if _crowded(points) else points.astype(np.float32)
    done = 1
    while done < n:
        new = order[done : done + min(done, BATCH)]
        proposed = walked(rough, links, np.array([entry]), rough[new], width, 1)[2]
        with_batch = np.concatenate([proposed, _nearest(points[new] @ points[new].T, new)], axis=1)
        links[new, :degree] = pruned(points, new, with_batch, degree, relax)
        _linked_back(points, links, new, degree, relax)
        done += len(new)
    full = np.flatnonzero(links[:, degree:].max(axis=1, initial=-1) >= 0)
    links[full, :degree] = pruned(points, full, links[full], degree, relax) if len(full) else -1
    return _connected(rough, links[:, :degree].copy(), entry, width), entry


def _tried(points: np.ndarray) -> np.ndarray:
    """Some vectors spread over the shard."""
    return points[np.linspace(0, len(points) - 1, min(TRIED, len(points))).astype(np.int64)]


def _crowded(points: np.ndarray, among: int = 8) -> bool:
    """Whether some vectors have neighbours so close that single precision tells them badly apart."""
    if len(points) <= among:
        return True
    products = [np.partition(points @ v, -among - 1)[-among - 1] for v in _tried(points)]
    return bool(np.mean(1 - np.array(products) < 2.0**-16) > 1 / 16)


def _reached(links: np.ndarray, entry: int) -> np.ndarray:
    """Which nodes a walk along the links from the entry can come to."""
    reached = np.zeros(len(links), bool)
    reached[entry] = True
    front = np.array([entry])
    while len(front):
        near = np.unique(links[front])
        front = near[(near >= 0)]
        front = front[~reached[front]]
        reached[front] = True
    return reached


def _connected(points: np.ndarray, links: np.ndarray, entry: int, width: int, each: int = 4) -> np.ndarray:
    """Links with an edge more, from the nearest node that is reached, to nodes that pruning cut off."""
    while len(lost := np.flatnonzero(~_reached(links, entry))):
        sources = []
        for at in range(0, len(lost), BATCH):
            part = lost[at : at + BATCH]
            found, close, _ = walked(points, links, np.array([entry]), points[part], width, 1)
            sources.append(found[np.arange(len(part)), close.argmax(axis=1)])
        source = np.concatenate(sources)
        order = np.argsort(source, kind="stable")
        source, lost = source[order], lost[order]
        nodes, first, more = np.unique(source, return_index=True, return_counts=True)
        nth = np.arange(len(source)) - np.repeat(first, more)
        column = np.repeat((links[nodes] >= 0).sum(axis=1), more) + nth
        now = nth < each  # more of one node wait for the next round, when others may be nearer
        if (wide := int(column[now].max()) + 1) > links.shape[1]:
            links = np.hstack([links, np.full((len(links), wide - links.shape[1]), -1, np.int32)])
        links[source[now], column[now]] = lost[now]
    return links


def _nearest(products: np.ndarray, ids: np.ndarray, most: int = 8) -> np.ndarray:
    """The nearest others of a batch for each of its members."""
    np.fill_diagonal(products, -np.inf)
    most = min(most, len(ids))
    return ids[np.argpartition(-products, most - 1, axis=1)[:, :most]]


def scored(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of each query with its row of vectors, summed in the order of the components."""
    out = np.zeros(vectors.shape[:2])
    for k in range(queries.shape[1]):
        out += queries[:, k, None] * vectors[:, :, k]
    return out


def entries_of(vectors: np.ndarray, entry: int, most: int = DEGREE) -> np.ndarray:
    """Where searches enter: the graph's entry and the longest vectors, which are large products of many queries."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    longest = np.argsort(-norms, kind="stable")[:most]
    return np.concatenate([[entry], longest[longest != entry]])


def measured_beam(points: np.ndarray, links: np.ndarray, entries: np.ndarray, k: int, beam: int, recall: float) -> int:
    """The beam, doubled from ``beam`` on, that finds enough of the ``k`` best for vectors spread over the shard."""
    queries = _tried(points)
    k = min(k, len(points))
    best = [np.argpartition(-(points @ v), k - 1)[:k] for v in queries]
    while beam < len(points):
        found = walked(points, links, entries, queries, beam)[0]
        if np.mean([np.isin(b, f).mean() for b, f in zip(best, found, strict=True)]) >= recall:
            break
        beam *= 2
    return beam


def single(vectors: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    """Vectors in single precision, divided by ``by`` so that they fit; that changes no order of products."""
    return np.ascontiguousarray(vectors / by, np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, vector) of the rows that take part, an id once."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~odd & some)
    once = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("vector"))
    return once.select("vec_id", F.size("vector").alias("dim"), "vector")


def shards_of(vectors: DataFrame, shards: int, shard_bytes: int) -> int:
    """How many shards keep each below its size in bytes."""
    size = vectors.agg(F.sum(8 * (F.col("dim") + 1).cast("long"))).first()[0] or 0
    return max(shards, -(-size // shard_bytes))


def indexed(vectors: DataFrame, shards: int, degree: int = DEGREE, width: int = WIDTH, relax: float = RELAX) -> DataFrame:
    """The index of (vec_id, dim, vector): (shard, dim, node, vector, ids, links, entry) for each different vector of a shard."""
    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "vec_id").select("shard", "dim", "vec_id", "vector")
    vector_type = rows.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
            column = table["vector"].combine_chunks()
            given = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            different, node = np.unique(given, axis=0, return_inverse=True)
            order = np.argsort(node.ravel(), kind="stable")  # ids ascend within a node
            starts = np.concatenate([[0], np.cumsum(np.bincount(node.ravel()))])
            ids = table["vec_id"].to_numpy()[order]
            links, entry = built(lifted(different.astype(np.float64)), degree, width, relax)
            step = 4096
            for low in range(0, len(different), step):
                part = different[low : low + step]
                n = len(part)
                has = links[low : low + n] >= 0
                offsets = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.arange(low, low + n, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(part.ravel(), column.type.value_type)),
                    pa.ListArray.from_arrays(pa.array((starts[low : low + n + 1] - starts[low]).astype(np.int32)), pa.array(ids[starts[low] : starts[low + n]])),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(links[low : low + n][has])),
                    pa.array(np.full(n, entry, np.int32))], ["shard", "dim", "node", "vector", "ids", "links", "entry"])

        for batch in batches:
            table = pa.table(batch.columns, names=["shard", "dim", "vec_id", "vector"])
            keys = list(zip(table["shard"].to_pylist(), table["dim"].to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, up in zip(cuts, cuts[1:], strict=False):
                if low == up:
                    continue
                if held and keys[low] != (held[0]["shard"][0].as_py(), held[0]["dim"][0].as_py()):
                    yield from done()
                    held.clear()
                held.append(table.slice(low, up - low))
        if held:
            yield from done()

    return rows.mapInArrow(run, f"shard int, dim int, node int, vector {vector_type}, ids array<bigint>, links array<int>, entry int")


def searched(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest products of each of (vec_id, dim, vector) with others."""
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = -(-max(1, queries.count()) // block)
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    nodes = index.select("shard", all_blocks.alias("block"), "dim", F.lit(0).alias("kind"), F.col("node").cast("long").alias("id"), "vector", "ids", "links", "entry")
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        "dim", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "vector",
        F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<int>").alias("links"), F.lit(None).cast("int").alias("entry"))
    rows = nodes.unionByName(asked).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block"))
    rows = rows.sortWithinPartitions("dim", "kind", "id").select("dim", "kind", "id", "vector", "ids", "links", "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        graph: list = []

        def loaded(dim: int) -> list:
            """Vectors, the same in single precision, links, entries and beam, and the ids of every node with where they begin."""
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = _matrix(table["vector"].combine_chunks(), dim)
            near = table["links"].combine_chunks()
            sizes = near.value_lengths().to_numpy()
            links = np.full((len(vectors), max(1, int(sizes.max()))), -1, np.int32)
            links[np.arange(links.shape[1]) < sizes[:, None]] = near.flatten().to_numpy()
            own = table["ids"].combine_chunks()
            entries = entries_of(vectors, table["entry"][0].as_py())
            starts = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            points = single(vectors, np.abs(vectors).max())
            return [vectors, points, links, entries, measured_beam(points, links, entries, k, beam, recall), own.flatten().to_numpy(), starts]

        def answer(ids: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
            vectors, points, links, entries, wide, own, starts = graph
            rough = single(asked, np.abs(asked).max(axis=1, keepdims=True))
            found, close, _ = walked(points, links, entries, rough, wide)
            least = np.full(len(ids), -np.inf)
            if wide > k + 1:  # one more than asked, as the query may be a node; less by what rounding can do
                most = np.sqrt(np.einsum("ij,ij->i", rough, rough) * np.einsum("ij,ij->i", points, points).max())
                least = np.partition(close, wide - k - 1, axis=1)[:, wide - k - 1] - most * rough.shape[1] * 2.0**-22
            r, column = np.nonzero((found >= 0) & (close >= least[:, None]))
            nodes = found[r, column]
            values = scored(asked[r], vectors[nodes][:, None])[:, 0]
            times = np.minimum(starts[nodes + 1] - starts[nodes], k + 1)
            firsts = np.repeat(starts[nodes], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            members, products, r = own[firsts], np.repeat(values, times), np.repeat(r, times)
            other = members != ids[r]
            members, products, r = members[other], products[other], r[other]
            order = np.lexsort((members, -products, r))
            counts = np.bincount(r, minlength=len(ids))
            best = order[np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts) < k]
            return pa.RecordBatch.from_arrays([pa.array(ids[r[best]], pa.int64()), pa.array(members[best], pa.int64()), pa.array(products[best], pa.float64())], ["query_id", "vec_id", "score"])

        names = ["dim", "kind", "id", "vector", "ids", "links", "entry"]
        at = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names)
            dims, kinds = batch["dim"].to_numpy(), batch["kind"].to_numpy()
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(kinds) != 0)) + 1
            for low, up in zip([0, *edges], [*edges, len(dims)], strict=True):
                if low == up:
                    continue
                part, dim = batch.slice(low, up - low), int(dims[low])
                if dim != at:
                    held.clear()
                    graph, at = [], dim
                if kinds[low] == 0:
                    held.append(part)
                    continue
                if not held and not graph:
                    continue  # no vector of this dimension in the shard
                if not graph:
                    graph = loaded(dim)
                    held.clear()
                ids, asked = part["id"].to_numpy(), _matrix(part["vector"], dim)
                step = max(1, min(BATCH, 8 * CELLS // (graph[4] * dim)))
                for i in range(0, len(ids), step):
                    yield answer(ids[i : i + step], asked[i : i + step])

    near = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, picked: Column | str, k: int = 20, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, beam: int = BEAM,
            recall: float = RECALL) -> DataFrame:
    """For the rows (vec_id, embedding) that ``picked`` holds for, their ``k`` nearest among all other rows."""
    vectors = written(usable(rows.select("vec_id", "embedding")), "vectors")
    index = written(indexed(vectors, shards_of(vectors, shards, shard_bytes)), "graph-index")
    return searched(index, vectors.where(picked), k, beam, recall)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
