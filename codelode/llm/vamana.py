"""Most similar vectors for every vector: a robust-pruned directed graph per shard, searched by beams.

Vectors are gathered into shards of about ``shard_rows`` around centroids; each gets its own graph. Nodes are inserted in
growing batches: a greedy beam search over the graph built so far proposes neighbours, relaxed distance pruning keeps
diverse edges, reverse edges are added and pruned again. Every query then runs a beam search on the graph of each shard
it is sent to, all of them up to ``fan``; the beams' best are scored exactly in float64 and merged. A query whose own
entity fills more than half of its beam is compared with all rows of the shard instead, so an entity of any size finds
its neighbours.

Defined results
* vectors that are null, of another length, zero, or hold null, NaN or infinite values take no part;
* rows with the same id count once; rows whose vectors are bit-identical share one graph node and are expanded after
  the search, so a group of copies of any size costs one node;
* similarity is rounded to 9 decimals, ties go to the smaller id; vectors of the same entity are never neighbours;
* an empty table, or one with a single entity, gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.session import shared_dir, ship

DIM = 64


# --- the graph of one shard, in numpy -------------------------------------------------------------------------------
def _take(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(a, order, axis=1)


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges for the nodes ``own`` [b] among the candidates ``cand`` [b, c] (-1: none), at most ``degree``.

    The nearest candidate is kept; candidates that are ``alpha`` times nearer to a kept one than to the node go.
    """
    b, c = cand.shape
    if c == 0:
        return np.full((b, degree), -1, np.int32)
    cand = np.sort(cand, axis=1)
    dead = (cand < 0) | (cand == own[:, None])
    dead[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    v = x[cand]
    d = 2 - 2 * np.einsum("bcd,bd->bc", v, x[own])
    d[dead] = np.inf
    order = np.argsort(d, axis=1)
    cand, d, v, dead = _take(cand, order), _take(d, order), np.take_along_axis(v, order[:, :, None], axis=1), _take(dead, order)
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((b, degree), -1, np.int32)
    rows = np.arange(b)
    kept = np.zeros(b, np.int64)
    for _ in range(degree):
        at = np.argmin(dead, axis=1)
        some = ~dead[rows, at]
        if not some.any():
            break
        out[rows[some], kept[some]] = cand[rows[some], at[some]]
        kept += some
        # squared distances on the sphere: a factor of alpha on distances is alpha squared here
        dead |= (alpha * alpha) * between[rows, at] <= d
        dead[rows, at] = True
        dead[~some] = True
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int, step: int = 4, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids [q, width] (-1: none) and similarities of the best nodes met; ``step`` nodes of each beam are opened at a time.

    ``own`` [q] are the queries' own nodes in this graph (-1: none), from which their search starts too.
    """
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    first = queries @ x[entries].T
    m = min(width, len(entries))
    top = np.argpartition(-first, m - 1, axis=1)[:, :m]
    ids = np.full((q, width), -1, np.int32)
    sims = np.full((q, width), -np.inf, np.float32)
    opened = np.ones((q, width), bool)
    ids[:, :m], sims[:, :m], opened[:, :m] = entries[top], _take(first, top), False
    if own is not None:
        j = np.flatnonzero((own >= 0) & ~(ids[:, :m] == own[:, None]).any(axis=1))
        last = np.argmin(sims[j, :m], axis=1)
        ids[j, last], sims[j, last] = own[j], np.einsum("qd,qd->q", x[own[j]], queries[j])
    order = np.argsort(-sims, axis=1)
    ids, sims, opened = _take(ids, order), _take(sims, order), _take(opened, order)
    r, c = np.nonzero(ids >= 0)
    seen[r, ids[r, c]] = True
    live = np.arange(q)
    while len(live):
        o, i, s = opened[live], ids[live], sims[live]
        pick = np.argsort(o, axis=1, kind="stable")[:, :step]  # the best that aren't open yet come first
        r = np.arange(len(live))[:, None]
        valid = ~o[r, pick]
        o[r, pick] = True
        near = np.where(valid[:, :, None], graph[np.maximum(i[r, pick], 0)], -1).reshape(len(live), -1)
        ok = near >= 0
        at = np.maximum(near, 0)
        ok &= ~seen[live[:, None], at]
        if step > 1:  # the same node from two opened ones
            near = np.where(ok, near, -1)
            near.sort(axis=1)
            at = np.maximum(near, 0)
            ok = near >= 0
            ok[:, 1:] &= near[:, 1:] != near[:, :-1]
        # only what is new is scored: flat, so that nothing is computed for gaps
        fr, fc = np.nonzero(ok)
        fa = at[fr, fc]
        seen[live[fr], fa] = True
        score = np.full(at.shape, -np.inf, np.float32)
        score[fr, fc] = np.einsum("nd,nd->n", x[fa], queries[live[fr]])
        s2, i2 = np.concatenate([s, score], axis=1), np.concatenate([i, np.where(ok, at, -1)], axis=1)
        o2 = np.concatenate([o, ~ok], axis=1)
        best = np.argpartition(-s2, width - 1, axis=1)[:, :width]
        s2 = _take(s2, best)
        order = np.argsort(-s2, axis=1)
        best = _take(best, order)
        ids[live], sims[live], opened[live] = _take(i2, best), _take(s2, order), _take(o2, best)
        live = live[~opened[live].all(axis=1)]
    return ids, sims


def entry_points(n: int, count: int = 1024) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, count)).astype(np.int64))


def build_graph(x: np.ndarray, degree: int = 32, width: int = 48, alpha: float = 1.05, block: int = 1024) -> np.ndarray:
    """The out-edges [n, degree] (-1: none) of unit vectors x [n, d]. Deterministic for a given order of x."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(7).permutation(n)
    done = min(n, 1024)
    head = order[:done]
    s = x[head] @ x[head].T
    near = head[np.argsort(-s, axis=1)[:, : 2 * degree]]
    graph[head] = robust_prune(x, head, near, degree, alpha)
    _reverse(x, graph, head, degree, alpha)
    while done < n:
        batch = order[done : done + min(done, block * 4)]
        entries = order[np.unique(np.linspace(0, done - 1, min(done, 512)).astype(np.int64))]
        for k in range(0, len(batch), block):
            part = batch[k : k + block]
            found, _ = beam_search(x, graph, entries, x[part], width)
            s = x[part] @ x[batch].T
            m = min(len(batch), 17)
            peers = batch[np.argpartition(-s, m - 1, axis=1)[:, :m]]
            graph[part] = robust_prune(x, part, np.concatenate([found, peers], axis=1), degree, alpha)
        _reverse(x, graph, batch, degree, alpha)
        done += len(batch)
    return graph


def _reverse(x: np.ndarray, graph: np.ndarray, own: np.ndarray, degree: int, alpha: float, most: int = 4) -> None:
    """Adds v -> u for every edge u -> v of the nodes ``own``; nodes that overflow are pruned again."""
    out = graph[own]
    src, dst = np.repeat(own, degree), out.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, start, counts = np.unique(dst, return_index=True, return_counts=True)
    span = degree * most
    by_count = np.argsort(counts, kind="stable")  # nodes with as many new edges go together, so little is padding
    nodes, start, counts = nodes[by_count], start[by_count], counts[by_count]
    k = 0
    while k < len(nodes):
        rows = 1024
        while rows > 64 and rows * (degree + min(int(counts[min(k + rows, len(nodes)) - 1]), span)) ** 2 > 8_000_000:
            rows //= 2
        v, st, ct = nodes[k : k + rows], start[k : k + rows], counts[k : k + rows]
        k += rows
        c = int(min(ct.max(), span))
        pos = st[:, None] + np.arange(c)
        new = np.where(np.arange(c) < ct[:, None], src[np.minimum(pos, len(src) - 1)], -1)
        if ct.max() > span:  # a hub: of its many new in-edges the nearest are candidates
            for j in np.flatnonzero(ct > span):
                mine = src[st[j] : st[j] + ct[j]]
                new[j] = mine[np.argsort(-(x[mine] @ x[v[j]]))[:c]]
        both = np.concatenate([graph[v], new], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        for some in (np.flatnonzero(~full), np.flatnonzero(full)):
            if len(some):
                graph[v[some]] = robust_prune(x, v[some], both[some], degree, alpha if full[some[0]] else 1e9)


def scan_others(exact: np.ndarray, m_id: np.ndarray, m_entity: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, block: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, entities, similarities) of the k nearest members of other entities than ``own`` [q], exactly, for each query."""
    sole = np.array([e[0] for e in m_entity])
    alone = np.array([(np.asarray(e) == e[0]).all() for e in m_entity])
    for b in range(0, len(queries), block):
        s = np.round(queries[b : b + block] @ exact.T, 9)
        s[alone & (sole == own[b : b + block, None])] = -np.inf
        m = min(k, s.shape[1])
        least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        for one, bound, e in zip(s, least, own[b : b + block]):
            at = np.flatnonzero((one >= bound) & (one > -np.inf))  # all that tie with the k-th, whose ids decide
            ids = np.concatenate([np.zeros(0, np.int64), *(m_id[j] for j in at)])
            ents = np.concatenate([np.zeros(0, np.int64), *(m_entity[j] for j in at)])
            sims = np.repeat(one[at], [len(m_id[j]) for j in at])
            other = ents != e
            ids, ents, sims = ids[other], ents[other], sims[other]
            order = np.lexsort((ids, -sims))[:k]
            yield ids[order], ents[order], sims[order]


# --- on Spark --------------------------------------------------------------------------------------------------------
def valid_vectors(df: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, entity: hash of entity_type and entity_id, vec: the float32 bytes) of the rows whose embedding counts."""
    src = df.select("id", F.xxhash64("entity_type", "entity_id").alias("entity"), F.col("embedding").cast("array<float>").alias("embedding")).filter(F.col("id").isNotNull() & (F.size("embedding") == dim))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            emb = b.column(2)
            flat = emb.flatten()
            x = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float32), nan=np.nan).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = np.ascontiguousarray(x[ok] + np.float32(0))  # -0.0 becomes 0.0
            raw = pa.py_buffer(x.tobytes())
            offsets = pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * (4 * dim)).tobytes())
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, raw])], ["id", "entity", "vec"])

    return src.mapInArrow(keep, "id long, entity long, vec binary")


def _matrix(col: pd.Series | list, dim: int = DIM) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def centroids(x: np.ndarray, count: int, least: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means over the sample x; those that attract fewer than ``least`` of it are dropped."""
    if count <= 1 or len(x) <= count:
        c = x.mean(axis=0, keepdims=True) if len(x) else np.zeros((1, x.shape[1]), np.float32)
        return (c / max(float(np.linalg.norm(c)), 1e-12)).astype(np.float32)
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), count, replace=False)]
    for r in range(rounds):
        own = np.concatenate([np.argmax(x[k : k + 8192] @ c.T, axis=1) for k in range(0, len(x), 8192)])
        size = np.bincount(own, minlength=len(c))
        if r == rounds - 1:
            return c[size >= least] if (size >= least).any() else c[:1]
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(size)
        total = np.zeros((len(c), x.shape[1]), np.float64)
        total[full] = np.add.reduceat(x[order].astype(np.float64), np.concatenate([[0], np.cumsum(size[full])[:-1]]))
        total[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c


def keep_for_all(ids: np.ndarray, ents: np.ndarray, sims: np.ndarray, sole: int | None, k: int) -> np.ndarray:
    """Which of a query's candidates to keep so that whoever asks, k of other entities are among them: at most 2 k."""
    order = np.lexsort((ids, -sims))
    if sole is not None:
        return order[ents[order] != sole][:k]
    out, seen = [], {}
    for j in order:
        e = int(ents[j])
        if seen.get(e, 0) < k:
            seen[e] = seen.get(e, 0) + 1
            out.append(j)
            if len(out) == 2 * k:
                break
    return np.array(out, np.int64)


def nearest(df: DataFrame, k: int = 10, shard_rows: int = 32768, fan: int = 8, degree: int = 32, width: int = 48, beam: int = 56, query_rows: int = 65536, dim: int = DIM, sample_rows: int = 65536) -> DataFrame:
    """(id, neighbour, similarity) of the k nearest of every valid vector.

    Vectors are gathered into shards by the nearest of some centroids, fitted on ``sample_rows`` of them; all are indexed.
    A query goes to the ``fan`` shards whose centroids are nearest, but for those that hold hardly any row of another
    entity than its own, so work and shuffle grow in proportion to the rows. What a task holds is one shard and
    ``query_rows`` queries; graphs are built with beams of ``width`` and searched with ``beam``; a shard answers at most 2 k candidates a query. The valid vectors, one node per distinct vector
    and the graphs go to the shared folder.
    """
    spark = df.sparkSession
    ship(spark)
    at = f"{shared_dir(spark)}/vamana-{uuid.uuid4().hex}"
    valid_vectors(df, dim).dropDuplicates(["id"]).write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")
    # of copies, the 2 k smallest ids with at most k of an entity: whatever entity asks, k others are among them.
    # row_number() <= n is applied before the shuffle too, so a huge group sends n rows a task.
    w1, w2 = Window.partitionBy("vec", "entity").orderBy("id"), Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w1)).filter(F.col("r") <= k).withColumn("r", F.row_number().over(w2)).filter(F.col("r") <= 2 * k)
    sole = F.when(F.min("entity") == F.max("entity"), F.min("entity")).alias("sole")
    nodes = few.groupBy("vec").agg(F.min("id").alias("node"), F.array_sort(F.collect_list(F.struct("id", "entity"))).alias("members"), sole)
    nodes.write.parquet(f"{at}/nodes")
    nodes = spark.read.parquet(f"{at}/nodes")
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, similarity double")
    count = max(1, -(-n // shard_rows)) if n <= 2 * shard_rows else -(-2 * n // shard_rows)
    sample = nodes.select("vec", F.xxhash64("node").alias("h")).sort("h").limit(sample_rows).collect() if count > 1 else []
    cells = centroids(_unit(_matrix([r["vec"] for r in sample], dim)), count, max(1, 8 * k * len(sample) // n)) if sample else np.zeros((1, dim), np.float32)
    shared = spark.sparkContext.broadcast(cells)  # at most 2 n / shard_rows vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.argmax(_unit(_matrix(b.column(1).to_pylist(), dim)) @ shared.value.T, axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32), pa.int32())], [*b.schema.names, "cell"])

    # a cell that came out larger than two shards is cut by hash; whoever asks it asks all its parts
    placed = nodes.select("node", "vec", "sole", F.col("members.id").alias("m_id"), F.col("members.entity").alias("m_entity")).mapInArrow(place, "node long, vec binary, sole long, m_id array<long>, m_entity array<long>, cell int")
    sizes = placed.groupBy("cell", "sole").count().groupBy("cell").agg(F.sum("count").alias("n"), F.max(F.when(F.col("sole").isNotNull(), F.struct("count", "sole"))).alias("most")).collect()
    parts = {r["cell"]: max(1, -(-r["n"] // (2 * shard_rows))) for r in sizes}
    # at most one entity can leave a cell fewer than k rows of others; its queries look elsewhere
    shunned = {r["cell"]: r["most"]["sole"] for r in sizes if len(sizes) > 1 and r["most"] and r["most"]["count"] > max(r["n"] - k, r["n"] // 2)}
    filled = np.array(sorted(parts))
    first = dict(zip(filled.tolist(), np.concatenate([[0], np.cumsum([parts[c] for c in filled.tolist()])[:-1]]).tolist()))  # a cell's first shard
    shards = sum(parts.values())

    def asks_of(blocks: dict[int, int] | None):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bad = np.array([shunned.get(c, 0) for c in filled.tolist()])
            has = np.array([c in shunned for c in filled.tolist()])
            for b in batches:
                at_, shard = [], []
                if b.num_rows:
                    d = _unit(_matrix(b.column(1).to_pylist(), dim)) @ shared.value[filled].T
                    own = b.column(2)
                    none = np.array(own.is_null())
                    d[has[None, :] & ~none[:, None] & (bad[None, :] == np.array(own.fill_null(0))[:, None])] = -np.inf
                    m = min(fan, d.shape[1])
                    best = np.argpartition(-d, m - 1, axis=1)[:, :m]
                    # copies of several entities may ask from one node: where any of them would look elsewhere, it does too
                    away = np.where(has[None, :], -np.inf, d)
                    other = np.argpartition(-away, m - 1, axis=1)[:, :m]
                    for i in range(b.num_rows):
                        chosen = [j for j in best[i].tolist() if d[i, j] > -np.inf]
                        if none[i] and has.any():
                            chosen += [j for j in other[i].tolist() if away[i, j] > -np.inf and j not in chosen]
                        for c in filled[chosen].tolist():
                            at_ += [i] * parts[c]
                            shard += range(first[c], first[c] + parts[c])
                idx, sh = pa.array(at_, pa.int32()), np.array(shard, np.int32)
                if blocks is None:
                    yield pa.RecordBatch.from_arrays([pa.array(sh)], ["shard"])
                    continue
                got = [c.take(idx) for c in (b.column(0), b.column(1), b.column(2).fill_null(0), b.column(2).is_null())]
                spread = (np.array(got[0]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block = (spread % np.array([blocks[x] for x in shard] or [1], np.uint64)[: len(sh)]).astype(np.int32) if len(sh) else sh
                yield pa.RecordBatch.from_arrays([pa.array(sh), pa.array(block), *got], ["shard", "block", "node", "vec", "sole", "mixed"])

        asked = nodes.select("node", "vec", "sole")
        return asked.mapInArrow(route, "shard int" if blocks is None else "shard int, block int, node long, vec binary, sole long, mixed boolean")

    asked = {r["shard"]: r["count"] for r in asks_of(None).groupBy("shard").count().collect()}
    # a shard's graph goes to one task per block of queries: few blocks, but work for every core
    spread = -(-spark.sparkContext.defaultParallelism // shards)
    blocks = {x: max(1, -(-asked.get(x, 0) // query_rows), min(-(-asked.get(x, 0) // 2048), spread)) for x in range(shards)}
    queries = asks_of(blocks)
    cut = spark.createDataFrame([(c, first[c], parts[c]) for c in parts], "cell int, first int, parts int")
    sharded = placed.join(F.broadcast(cut), "cell").select((F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("shard"), "node", "vec", "m_id", "m_entity")

    def graph_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        x = _unit(_matrix(pdf.vec, dim))
        g = build_graph(x, degree, width)
        return pd.DataFrame({"shard": pdf.shard.to_numpy(), "node": pdf.node.to_numpy(), "vec": pdf.vec.to_numpy(), "edges": [r.tobytes() for r in g], "m_id": pdf.m_id.to_numpy(), "m_entity": pdf.m_entity.to_numpy()})

    sharded.groupBy("shard").applyInPandas(graph_of, "shard int, node long, vec binary, edges binary, m_id array<long>, m_entity array<long>").write.parquet(f"{at}/graphs")
    copies = spark.createDataFrame(list(blocks.items()), "shard int, blocks int")
    graphs = spark.read.parquet(f"{at}/graphs").join(F.broadcast(copies), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", "node", "vec", "edges", "m_id", "m_entity")

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"node": [], "near": [], "sims": [], "ents": []}
        if len(left) and len(right):
            raw = _matrix(left.vec, dim)
            x, g = _unit(raw), np.stack([np.frombuffer(e, np.int32) for e in left.edges])
            raw = raw.astype(np.float64)
            exact = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            m_id, m_entity = left.m_id.to_numpy(), left.m_entity.to_numpy()
            size = np.array([len(m) for m in m_id])
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            all_id, all_ent = np.concatenate(m_id), np.concatenate(m_entity)
            lone = np.array([(np.asarray(e) == e[0]).all() for e in m_entity])
            owner = all_ent[begin]
            here = pd.Index(left.node)
            for b in range(0, len(right), 512):
                part = right.iloc[b : b + 512]
                q_raw = _matrix(part.vec, dim).astype(np.float64)
                q_exact = q_raw / np.linalg.norm(q_raw, axis=1, keepdims=True)
                ids, _ = beam_search(x, g, entry_points(len(x)), q_exact.astype(np.float32), beam, own=here.get_indexer(part.node))
                s = np.round(np.einsum("qkd,qd->qk", exact[np.maximum(ids, 0)], q_exact), 9)
                own, mixed = part.sole.tolist(), part.mixed.tolist()
                for i, (node, one, sim) in enumerate(zip(part.node.tolist(), ids, s)):
                    sole_ = None if mixed[i] else own[i]
                    ok = one >= 0
                    # an entity that fills most of the beam and may ask: it is compared with all of the shard's others
                    lords = owner[one[ok & lone[one]]]
                    fills = None
                    if 2 * len(lords) > ok.sum() and len(x) > ok.sum():
                        e, c = np.unique(lords, return_counts=True)
                        if 2 * c.max() > ok.sum() and (sole_ is None or sole_ == e[c.argmax()]):
                            fills = int(e[c.argmax()])
                    more = next(scan_others(exact, m_id, m_entity, q_exact[i : i + 1], np.array([fills]), k)) if fills is not None else None
                    if sole_ is not None:
                        ok &= ~(lone[one] & (owner[one] == sole_))
                    one, sim = one[ok], sim[ok]
                    reps = size[one]
                    if (reps == 1).all():
                        flat = begin[one]
                    else:
                        flat = np.concatenate([np.arange(begin[j], begin[j] + size[j]) for j in one])
                        sim = np.repeat(sim, reps)
                    near, ents = all_id[flat], all_ent[flat]
                    if fills is not None and sole_ is not None:
                        near, ents, sim = more[0], more[1], more[2]
                    else:
                        keep = keep_for_all(near, ents, sim, sole_, k)
                        near, ents, sim = near[keep], ents[keep], sim[keep]
                        if more is not None:
                            fresh = ~np.isin(more[0], near)
                            near, ents, sim = (np.concatenate([u, v[fresh]]) for u, v in zip((near, ents, sim), more))
                    out["node"].append(node)
                    out["near"].append(near)
                    out["sims"].append(sim)
                    out["ents"].append(ents)
        return pd.DataFrame({"node": pd.Series(out["node"], dtype="int64"), **{c: pd.Series(out[c], dtype=object) for c in ("near", "sims", "ents")}})

    found = graphs.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(search, "node long, near array<long>, sims array<double>, ents array<long>")
    best = found.groupBy("node").agg(F.flatten(F.collect_list(F.arrays_zip(F.transform("sims", lambda s: -s).alias("s"), F.col("near").alias("n"), F.col("ents").alias("e")))).alias("all"))
    # every row of the node's copies asks with its own entity; the join's hot side is one row a node
    asks = rows.select("id", "entity", "vec").join(nodes.select("vec", "node"), "vec").select("id", "entity", "node")
    top = asks.join(best, "node").select("id", F.slice(F.array_sort(F.filter("all", lambda a: (a["n"] != F.col("id")) & (a["e"] != F.col("entity")))), 1, k).alias("top"))
    return top.select("id", F.explode("top").alias("t")).select("id", F.col("t.n").alias("neighbour"), (-F.col("t.s")).alias("similarity"))
