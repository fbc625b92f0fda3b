"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

Distinct vectors are dealt by a hash to shards of about SHARD_BYTES (16 384 vectors of 64 dimensions), which bounds a task's memory.  A shard's graph is built in numpy: nodes enter in batches whose beam searches run in
lockstep, and every layer is one flat neighbour array (nodes x degree, -1 padded).  The graphs are written as a table of
binary columns; a search joins graphs and blocks of queries by shard, scores what the beams find in double precision on the original vectors, and the best of all shards are ranked.

Every query asks every shard, as the method says, so the work is queries times shards: a larger SHARD_BYTES, as large as executors allow, lowers it.  A
shard's index travels once for BLOCK queries.

Equal vectors are indexed once, with the smallest ids that can be among the answers: a vector that a third of the rows repeat neither
fills a shard nor breaks the order of ties.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or as candidate; identical rows count once; rows of one id
with different vectors are queries of their own and not candidates of each other; null ids take no part; vectors of another dimension than the query's are no candidates;
fewer candidates than k are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARD_BYTES = 8 << 20  # of a shard's vectors in double precision
DEGREE, BUILD_BEAM, WAY_BEAM, SEARCH_BEAM, BATCH, BLOCK = 16, 64, 16, 128, 128, 32768


class Graph:
    """``layers[l]``: (members, neighbours); neighbours are node numbers, members the nodes of the layer, sorted."""

    def __init__(self, vectors: np.ndarray):
        self.unit = (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))).astype(np.float32)
        self.layers: list[np.ndarray] = []
        self.level = np.zeros(0, np.int64)
        self.entry = 0

    def build(self, seed: int = 5) -> Graph:
        n = len(self.unit)
        u = np.random.default_rng(seed).random(n)
        self.level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE)).astype(np.int64), 6)
        order = np.argsort(-self.level, kind="stable")  # upper layers are complete before the lower ones grow
        self.entry = int(order[0])
        self.layers = [np.full((n, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max()) + 1)]
        for lo in range(0, n, BATCH):
            self._insert(order[lo : lo + BATCH], order[:lo])
        return self

    def _insert(self, nodes: np.ndarray, present: np.ndarray) -> None:
        q = self.unit[nodes]
        peers = q @ q.T
        np.fill_diagonal(peers, -9)
        start = np.full((len(nodes), 1), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            on = self.level[nodes] >= layer
            old = present[self.level[present] >= layer]
            ids, sims = np.full((len(nodes), 1), -1), np.full((len(nodes), 1), -9.0, np.float32)
            if len(old):
                ids, sims = self._beam(q, start, layer, BUILD_BEAM if on.any() else WAY_BEAM)
                start = ids[:, :WAY_BEAM]
            if not on.any():
                continue
            rows = np.flatnonzero(on)
            ids = np.concatenate([ids[rows], np.broadcast_to(nodes[rows], (len(rows), len(rows)))], 1)
            sims = np.concatenate([sims[rows], peers[np.ix_(rows, rows)]], 1)
            best = np.argsort(-sims, 1, kind="stable")[:, :DEGREE]
            got, near = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            ok = (near > -5) & (got >= 0)
            graph = self.layers[layer]
            a = np.repeat(nodes[rows], ok.sum(1))
            b = got[ok]
            self._link(graph, np.concatenate([a, b]), np.concatenate([b, a]))

    def _link(self, graph: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Add edges; a full node keeps diverse neighbours first.

        From near to far, a neighbour is kept if it is nearer to the node than to any neighbour kept so far, so that edges lead out of
        a tight cluster; places that stay free go to the nearest of the others.
        """
        touched = np.unique(source)
        held = graph[touched]
        width = held.shape[1]
        s = np.concatenate([np.repeat(touched, width), source])
        t = np.concatenate([held.ravel(), target])
        s, t = s[t >= 0], t[t >= 0]
        both = np.unique(s.astype(np.int64) * len(self.unit) + t)
        s, t = both // len(self.unit), both % len(self.unit)
        sim = np.einsum("ij,ij->i", self.unit[s], self.unit[t])
        by = np.lexsort((t, -sim, s))
        s, t, sim = s[by], t[by], sim[by]
        first = np.searchsorted(s, s, "left")
        rank = np.arange(len(s)) - first
        graph[touched] = -1
        size = np.diff(np.append(np.flatnonzero(rank == 0), len(s)))
        row = np.repeat(np.arange(len(size)), size)
        roomy = size[row] <= width
        graph[s[roomy], rank[roomy]] = t[roomy]
        full = np.flatnonzero(size > width)
        most = 2 * width  # candidates beyond twice the room are farther than that many others
        for lo in range(0, len(full), 256):
            part = full[lo : lo + 256]
            number = np.full(len(size), -1)
            number[part] = np.arange(len(part))
            mine = (number[row] >= 0) & (rank < most)
            ids, near = np.full((len(part), most), -1), np.full((len(part), most), -9.0, np.float32)
            ids[number[row[mine]], rank[mine]], near[number[row[mine]], rank[mine]] = t[mine], sim[mine]
            v = self.unit[np.maximum(ids, 0)]
            among = v @ v.transpose(0, 2, 1)
            kept = np.zeros(ids.shape, bool)
            for k in range(most):
                blocked = (kept[:, :k] & (among[:, k, :k] > near[:, k, None])).any(1)
                kept[:, k] = (ids[:, k] >= 0) & ~blocked & (kept[:, :k].sum(1) < width)
            order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), 1, kind="stable")[:, :width]
            graph[touched[part]] = np.take_along_axis(ids, order, 1)

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` nodes of each query (ids, similarities), -1 padded, from its ``start`` nodes; all beams step together."""
        graph, n = self.layers[layer], len(q)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -9, np.float32)
        done = np.ones((n, width), bool)
        start = start[:, :width]
        some = start.shape[1]
        ids[:, :some], done[:, :some] = start, start < 0
        sims[:, :some] = np.where(start >= 0, np.einsum("ij,ikj->ik", q, self.unit[np.maximum(start, 0)]), -9)
        seen = np.zeros((n, len(self.unit)), bool)
        r, c = np.nonzero(start >= 0)
        seen[r, start[r, c]] = True
        active = np.arange(n)
        step = 1 if width == 1 else 3
        while len(active):
            rank = np.where(done[active], np.int64(1 << 30), np.arange(width))
            pick = np.sort(rank, 1)[:, :step]
            valid = pick < width
            some = valid.any(1)
            active, pick, valid = active[some], pick[some], valid[some]
            if not len(active):
                break
            at = np.where(valid, pick, 0)
            nodes = np.where(valid, np.take_along_axis(ids[active], at, 1), -1)
            r, c = np.nonzero(valid)
            done[active[r], at[r, c]] = True
            near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(active), -1)
            r, c = np.nonzero((near >= 0) & ~seen[active[:, None], near])
            flat = near[r, c].astype(np.int64)
            pair = np.unique(r * np.int64(len(self.unit)) + flat)
            r, flat = pair // len(self.unit), pair % len(self.unit)
            seen[active[r], flat] = True
            sim = np.einsum("ij,ij->i", q[active[r]], self.unit[flat])
            count = np.bincount(r, minlength=len(active))
            most = int(count.max(initial=0))
            if not most:
                continue
            column = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            new_ids = np.full((len(active), most), -1, np.int64)
            new_sims = np.full((len(active), most), -9, np.float32)
            new_ids[r, column], new_sims[r, column] = flat, sim
            all_sims = np.concatenate([sims[active], new_sims], 1)
            best = np.argsort(-all_sims, 1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(np.concatenate([ids[active], new_ids], 1), best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], new_ids < 0], 1), best, 1)
        return ids, sims

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_BEAM) -> np.ndarray:
        """Node numbers of the k nearest found of each query, -1 padded; queries are unit vectors."""
        out = []
        for lo in range(0, len(q), BATCH):
            part = q[lo : lo + BATCH].astype(np.float32)
            start = np.full((len(part), 1), self.entry)
            for layer in range(len(self.layers) - 1, 0, -1):
                start = self._beam(part, start, layer, WAY_BEAM)[0]
            out.append(self._beam(part, start, 0, max(width, k))[0][:, :k])
        return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def _index(key: tuple, rows: pa.Table) -> pa.Table:
    """One shard -> one row: ids (up to the kept number for each vector), vectors and the flat arrays of the graph."""
    vectors = np.array(rows["v"].to_pylist(), np.float64)
    g = Graph(vectors).build()
    ids = [x[:] for x in rows["ids"].to_pylist()]
    width = max(len(x) for x in ids)
    flat = np.full((len(ids), width), -1, np.int64)
    real = np.zeros((len(ids), width), bool)
    for i, x in enumerate(ids):
        flat[i, : len(x)], real[i, : len(x)] = x, True
    cols = dict(dim=[vectors.shape[1]], shard=[key[1].as_py()], width=[width], entry=[g.entry], ids=[flat.tobytes()], real=[real.tobytes()], vectors=[vectors.tobytes()], layers=[[x.tobytes() for x in g.layers]])
    kinds = dict(dim=pa.int32(), shard=pa.int64(), width=pa.int32(), entry=pa.int64(), ids=pa.binary(), real=pa.binary(), vectors=pa.binary(), layers=pa.list_(pa.binary()))
    return pa.table({k: pa.array(v, kinds[k]) for k, v in cols.items()})


def _searcher(k: int):
    def search(key: tuple, graphs: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if graphs.num_rows and queries.num_rows:
            g0 = graphs.slice(0, 1).to_pylist()[0]
            vectors = np.frombuffer(g0["vectors"], np.float64).reshape(-1, g0["dim"])
            ids = np.frombuffer(g0["ids"], np.int64).reshape(len(vectors), -1)
            real = np.frombuffer(g0["real"], bool).reshape(ids.shape)
            g = Graph(vectors)
            g.entry, g.layers = g0["entry"], [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in g0["layers"]]
            norms = np.sqrt((vectors * vectors).sum(1))
            q_id, q_row = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
            q = np.array(queries["v"].to_pylist(), np.float64)
            length = np.sqrt((q * q).sum(1))
            found = g.search(q / length[:, None], 2 * k + 2)
            for lo in range(0, len(q), 512):
                hi = min(lo + 512, len(q))
                near = found[lo:hi]
                score = (q[lo:hi, None, :] * vectors[near]).sum(2) / (length[lo:hi, None] * norms[near])
                cand, ok = ids[near], real[near] & (near >= 0)[:, :, None] & (ids[near] != q_id[lo:hi, None, None])
                r, c, m = np.nonzero(ok)
                ids_out, s = cand[r, c, m], score[r, c]
                by = np.lexsort((ids_out, -s, r))
                r, ids_out, s = r[by], ids_out[by], s[by]
                keep = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
                for o, v in zip(out, (q_id[lo:hi][r], q_row[lo:hi][r], ids_out, s)):
                    o.append(v[keep])
        cat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "row": pa.array(cat[1].astype(np.int64)), "vec_id": pa.array(cat[2].astype(np.int64)), "score": pa.array(cat[3].astype(np.float64))})

    return search


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, shard: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    v = F.col(vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.where(F.coalesce(fine, F.lit(False))).withColumn("row", F.xxhash64("vec_id", "v")).withColumn("same", F.xxhash64("v"))
    # Of rows with one vector only the k + 1 smallest ids can be answers.
    first = Window.partitionBy("same", "v").orderBy("vec_id")
    few = base.select("vec_id", "v", "same", F.dense_rank().over(first).alias("place")).where(F.col("place") <= k + 1)
    distinct = few.groupBy("same", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("dim", F.size("v"))
    distinct = materialise(distinct, "ann-vectors")
    dims = distinct.groupBy("dim").agg(F.ceil(F.count("*") / (F.lit(shard) if shard else F.greatest(F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))), F.lit(1)))).cast("long").alias("shards"))
    dealt = distinct.join(F.broadcast(dims), "dim") if dims.count() <= 10_000 else distinct.join(dims, "dim")
    dealt = dealt.select("dim", F.pmod(F.xxhash64("same", F.lit(1)), F.col("shards")).alias("shard"), "v", "ids")
    index = dealt.groupBy("dim", "shard").applyInArrow(_index, "dim int, shard long, width int, entry long, ids binary, real binary, vectors binary, layers array<binary>")
    index = materialise(index, "ann-index")
    queries = base.where(F.col("vec_id") % every == 0).select("vec_id", "v", "row").dropDuplicates(["vec_id", "row"]).withColumn("dim", F.size("v"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    plan = dims.join(blocks, "dim")
    asked = queries.join(F.broadcast(plan) if dims.count() <= 10_000 else plan, "dim").select("dim", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "vec_id", "row", "v")
    held = index.join(F.broadcast(blocks) if dims.count() <= 10_000 else blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(_searcher(k), "query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.dropDuplicates(["query_id", "row", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
