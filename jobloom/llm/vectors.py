"""Approximate nearest neighbours by inner product: hierarchical navigable small-world graphs, one a shard.

Vectors are dealt to shards of bounded size. Each shard's graph is built in one task by insertion: a new node is searched for from
the top level down, and linked on each of its levels to the nearest ones found that aren't as close to a link chosen before. A
level is a flat array of neighbours, fixed places a node. Searches go through all shards in blocks of queries, and shards' best are merged.

The graph's distance is Euclidean over vectors with one more component, sqrt(M^2 - |v|^2), M being the largest norm of all: with a
query whose further component is 0, its order is that of the inner product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import stored

#: Vectors a shard and queries a block, at about.
SHARD_ROWS, QUERIES_AT_ONCE = 1 << 13, 1 << 11
#: Links a node above the lowest level (twice as many there), nodes kept in a search while building, nodes expanded at once.
LINKS, BUILD_WIDTH, AT_ONCE = 16, 96, 4
#: Squared distances of unit vectors in single precision that may be none.
_ALIKE = 1e-6

GRAPH = "dim int, shard long, vectors binary, firsts binary, vec_ids binary, row_ids binary, sizes binary, nodes binary, links binary"


class Graph:
    """A graph over ``x`` (float32, a vector a row): by level, from the lowest, its nodes and their links as positions among them; -1 is no link."""

    def __init__(self, x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.nodes, self.links = x, nodes, links

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 0) -> Graph:
        """Inserts the vectors in order, in batches of at most a quarter of what is there; a batch's vectors are candidates of each other too."""
        n = len(x)
        draws = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(int), 12)
        nodes = [np.flatnonzero(level >= k) for k in range(int(level.max()) + 1)]
        graph = cls(x, nodes, [np.full((len(v), 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k, v in enumerate(nodes)])
        done = min(n, 64)
        graph._insert(0, done)
        while done < n:
            more = min(n, done + min(512, max(64, done // 4)))
            graph._insert(done, more)
            done = more
        return graph

    def _insert(self, first: int, last: int) -> None:
        """Links nodes ``first`` to ``last``, by number, to those before them and to each other."""
        new = np.arange(first, last)
        near = None
        for k in range(len(self.nodes) - 1, -1, -1):
            nodes = self.nodes[k]
            old, upto = np.searchsorted(nodes, (first, last))
            mine = nodes[old:upto] - first
            found, far = np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), np.inf, np.float32)
            if old:  # searched for among those that are there, from the nearest found one level up
                start = self._places(k, near, old) if near is not None else np.zeros((len(new), 1), np.int32)
                found, far = self._beam(k, self.x[new], start, BUILD_WIDTH if k == 0 else 8)
                near = np.where(found[:, :4] >= 0, nodes[np.maximum(found[:, :4], 0)], -1)
                if k and len(mine):
                    wide, wide_far = self._beam(k, self.x[new[mine]], found[mine], BUILD_WIDTH)
                    found, far = np.full((len(new), BUILD_WIDTH), -1, np.int32), np.full((len(new), BUILD_WIDTH), np.inf, np.float32)
                    found[mine], far[mine] = wide, wide_far
            if upto > old:
                own = _distances(self.x[nodes[old:upto]], self.x[nodes[old:upto]])
                np.fill_diagonal(own, np.inf)
                take = min(BUILD_WIDTH, upto - old)
                place = np.argpartition(own, take - 1, axis=1)[:, :take]
                ids = np.concatenate((found[mine], (old + place).astype(np.int32)), axis=1)
                dist = np.concatenate((far[mine], np.take_along_axis(own, place, axis=1)), axis=1)
                ids = np.where(np.isinf(dist), -1, ids)
                width = self.links[k].shape[1]
                chosen, how_far = self._spread(k, ids, dist, LINKS)
                self.links[k][old:upto, :LINKS] = chosen
                self._back(k, np.arange(old, upto, dtype=np.int32), chosen, how_far, width)

    def _places(self, k: int, near: np.ndarray, old: int) -> np.ndarray:
        """Nodes as places among the first ``old`` of level ``k``; every node of a level is on all lower ones."""
        at = np.searchsorted(self.nodes[k], np.maximum(near, 0)).astype(np.int32)
        return np.where(near >= 0, at, -1)

    def _spread(self, k: int, ids: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates (-1: none), nearest first, those nearer to the row's node than to any chosen before; then the nearest others, up to ``most``."""
        order = np.argsort(np.where(ids < 0, np.inf, dist), axis=1, kind="stable")[:, : 3 * most]
        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        width = ids.shape[1]
        there = ids >= 0
        there[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        v = self.x[self.nodes[k][np.maximum(ids, 0)]]
        norm = np.einsum("rcd,rcd->rc", v, v)
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros_like(there)
        shadow = np.zeros_like(there)  # as near to a chosen one as to the node, so that a clump of copies takes one link, not all
        for c in range(width):
            take = there[:, c] & ~shadow[:, c] & (kept.sum(axis=1) < most)
            kept[:, c] = take
            shadow |= take[:, None] & (between[:, c, :] <= dist + _ALIKE)
        rank = np.where(kept, 0, np.where(there, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        ids, dist, rank = (np.take_along_axis(a, order, axis=1) for a in (ids, dist, rank))
        ids, dist = np.where(rank < 2, ids, -1), np.where(rank < 2, dist, np.inf)
        if width < most:
            pad = ((0, 0), (0, most - width))
            ids, dist = np.pad(ids, pad, constant_values=-1), np.pad(dist, pad, constant_values=np.inf)
        return ids.astype(np.int32), dist

    def _back(self, k: int, new: np.ndarray, chosen: np.ndarray, dist: np.ndarray, width: int) -> None:
        """Links chosen nodes back to the new ones; a node that gets too many keeps a spread of them."""
        links, nodes = self.links[k], self.nodes[k]
        r, c = np.nonzero(chosen >= 0)
        target, source, far = chosen[r, c], new[r], dist[r, c]
        order = np.argsort(target, kind="stable")
        target, source, far = target[order], source[order], far[order]
        starts = np.flatnonzero(np.diff(target, prepend=-1))
        counts = np.diff(np.append(starts, len(target)))
        who = target[starts]
        extra = np.full((len(who), int(counts.max(initial=0))), -1, np.int32)
        row = np.repeat(np.arange(len(who)), counts)
        extra[row, np.arange(len(target)) - np.repeat(starts, counts)] = source
        both = np.concatenate((links[who], extra), axis=1)
        have = (both >= 0).sum(axis=1)
        few = have <= width
        if few.any():
            links[who[few]] = np.take_along_axis(both[few], np.argsort(both[few] < 0, axis=1, kind="stable"), axis=1)[:, :width]
        many = np.flatnonzero(~few)
        for part in np.array_split(many, max(1, -(-len(many) // 512))):
            if len(part):
                ids = both[part]
                v = self.x[nodes[np.maximum(ids, 0)]] - self.x[nodes[who[part]]][:, None, :]
                far = np.where(ids >= 0, np.einsum("rcd,rcd->rc", v, v), np.inf)
                links[who[part]] = self._spread(k, ids, far, width)[0]

    def _beam(self, k: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes of level ``k`` found for each query, nearest first, from its starting places (-1: none), and their distances.

        All queries go on at once: each expands its nearest nodes that weren't yet, until none of its ``width`` best is left to expand.
        """
        out_ids, out_far = [], []
        for a in range(0, len(q), 512):
            ids, far = self._beam_part(k, q[a : a + 512], start[a : a + 512], width)
            out_ids.append(ids)
            out_far.append(far)
        return np.concatenate(out_ids), np.concatenate(out_far)

    def _beam_part(self, k: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        x, nodes, links = self.x, self.nodes[k], self.links[k]
        n, b = len(nodes), len(q)
        seen = np.zeros(b * n, bool)
        ids = np.full((b, width), -1, np.int32)
        far = np.full((b, width), np.inf, np.float32)
        open_ = np.zeros((b, width), bool)
        q_norm = np.einsum("rd,rd->r", q, q)

        def add(rows: np.ndarray, found: np.ndarray) -> None:
            """Merges nodes not seen before into their queries' best."""
            key = rows.astype(np.int64) * n + found
            fresh = ~seen[key]
            key = np.unique(key[fresh])
            seen[key] = True
            rows, found = key // n, key % n
            v = x[nodes[found]]
            d = q_norm[rows] + np.einsum("rd,rd->r", v, v) - 2 * np.einsum("rd,rd->r", v, q[rows])
            near = d < far[rows, -1]
            rows, found, d = rows[near], found[near], d[near]
            if not len(rows):
                return
            who, starts, counts = np.unique(rows, return_index=True, return_counts=True)
            m = int(counts.max())
            line = np.repeat(np.arange(len(who)), counts)
            cell = np.arange(len(rows)) - np.repeat(starts, counts)
            new_far = np.full((len(who), m), np.inf, np.float32)
            new_ids = np.full((len(who), m), -1, np.int32)
            new_far[line, cell], new_ids[line, cell] = d, found
            all_far, all_ids = np.concatenate((far[who], new_far), axis=1), np.concatenate((ids[who], new_ids), axis=1)
            all_open = np.concatenate((open_[who], new_ids >= 0), axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            far[who], ids[who], open_[who] = (np.take_along_axis(a, order, axis=1) for a in (all_far, all_ids, all_open))

        r, c = np.nonzero(start >= 0)
        add(r, start[r, c])
        while True:
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return ids, far
            nth = np.cumsum(open_[active], axis=1)
            r, c = np.nonzero(open_[active] & (nth <= AT_ONCE))
            r = active[r]
            open_[r, c] = False
            found = links[ids[r, c]]
            rows = np.repeat(r, found.shape[1])
            found = found.ravel()
            add(rows[found >= 0], found[found >= 0])

    def nearest(self, q: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` nearest nodes found for each query, nearest first; -1 where there are fewer."""
        near = np.full((len(q), 1), self.nodes[-1][0])
        for k in range(len(self.nodes) - 1, -1, -1):
            found, _ = self._beam(k, q, self._places(k, near, len(self.nodes[k])), width if k == 0 else 8)
            near = np.where(found >= 0, self.nodes[k][np.maximum(found, 0)], -1)
        return near

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels' sizes, nodes and links as flat arrays."""
        return np.array([len(v) for v in self.nodes], np.int32), np.concatenate(self.nodes).astype(np.int32), np.concatenate([a.ravel() for a in self.links]).astype(np.int32)

    @classmethod
    def from_flat(cls, x: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, links: np.ndarray) -> Graph:
        widths = np.full(len(sizes), LINKS)
        widths[0] = 2 * LINKS
        cut = np.cumsum(sizes * widths)[:-1]
        return cls(x, np.split(nodes, np.cumsum(sizes)[:-1]), [a.reshape(-1, w) for a, w in zip(np.split(links, cut), widths, strict=True)])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("rd,rd->r", a, a)[:, None] + np.einsum("rd,rd->r", b, b)[None, :] - 2 * a @ b.T


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors divided by the largest norm of all, with the component that makes each a unit."""
    scaled = vectors / largest
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("rd,rd->r", scaled, scaled)))
    return np.concatenate((scaled, rest[:, None]), axis=1).astype(np.float32)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, vector, dim, norm) of the rows whose vector isn't null, empty or zero and has finite components only; ``row`` is a number of its own. Stored."""
    vector = F.transform(vector_col, lambda c: c.cast("double"))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, c: a + c * c))
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(finite)
    kept = good.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.size(vector_col).alias("dim"), norm.alias("norm")).where("norm > 0")
    return stored(kept.withColumn("row", F.monotonically_increasing_id()))


def points(vectors: DataFrame, k: int) -> DataFrame:
    """The different vectors of ``vectors`` (as of ``usable``), stored: point, vector, dim, norm, members.

    ``members`` are the k + 1 rows of smallest vec_id that have the vector, as (vec_id, row): no list of k neighbours, the asking row left out, can have others of
    equal score. They are cut within tasks first, so a vector that very many rows have is safe.
    """
    nth = F.row_number().over(Window.partitionBy("hash", "vector").orderBy("vec_id", "row"))
    first = vectors.withColumns({"hash": F.xxhash64("vector"), "vec_id": F.coalesce("vec_id", F.lit(_NULL))}).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    alike = first.groupBy("hash", "vector").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    return stored(alike.drop("hash").withColumn("point", F.monotonically_increasing_id()))


def _shards(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("long")


def index(points: DataFrame, sizes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of ``points``, a row each, stored. ``sizes``: dim, n, largest norm; vectors of different sizes have different graphs."""
    dealt = points.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("point"), _shards(F.col("n"), shard_rows)))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point")
        v = np.stack(frame["vector"].to_numpy())
        graph = Graph.build(_lifted(v, float(frame["largest"].iloc[0])))
        firsts = np.concatenate(([0], np.cumsum(frame["ids"].map(len).to_numpy())))
        parts = (v, firsts, np.concatenate(frame["ids"].to_list()), np.concatenate(frame["rows"].to_list()), *graph.flat())
        return pd.DataFrame([[key[0], key[1], *(a.tobytes() for a in parts)]], columns=[c.split()[0] for c in GRAPH.split(", ")])

    return stored(dealt.select("dim", "shard", "point", "vector", "largest", F.col("members.vec_id").alias("ids"), F.col("members.row").alias("rows")).groupBy("dim", "shard").applyInPandas(build, GRAPH))


_NULL = (1 << 63) - 1


def search(graphs: DataFrame, queries: DataFrame, sizes: DataFrame, k: int = 20, width: int = 160, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest rows found for each of ``queries`` (as of ``usable``), its own row left out: query_id, rank, vec_id, score.

    Queries are packed in blocks, each block meets each graph of its size once, and each graph gives its ``k`` best by inner product in double precision.
    """
    asked = queries.groupBy("dim").agg(F.count(F.lit(1)).alias("asked"))
    block = F.pmod(F.xxhash64("row"), F.ceil(F.col("asked") / QUERIES_AT_ONCE).cast("long"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "q_vectors": [np.stack(frame["vector"].to_numpy()).tobytes()], "q_rows": [frame["row"].to_numpy(np.int64).tobytes()]})

    blocks = stored(queries.join(F.broadcast(asked), "dim").withColumn("block", block).select("dim", "block", "row", "vector").groupBy("dim", "block").applyInPandas(pack, "dim int, block long, q_vectors binary, q_rows binary"))
    meets = blocks.join(F.broadcast(sizes), "dim").select("*", F.explode(F.sequence(F.lit(0).cast("long"), _shards(F.col("n"), shard_rows) - 1)).alias("shard")).drop("n")
    pairs = graphs.join(meets, ["dim", "shard"])

    def best(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dim, out = key[0], []
        for g in frame.itertuples():
            v = np.frombuffer(g.vectors, np.float64).reshape(-1, dim)
            firsts, ids, rows = (np.frombuffer(a, np.int64) for a in (g.firsts, g.vec_ids, g.row_ids))
            graph = Graph.from_flat(_lifted(v, g.largest), *(np.frombuffer(a, np.int32) for a in (g.sizes, g.nodes, g.links)))
            q, q_rows = np.frombuffer(g.q_vectors, np.float64).reshape(-1, dim), np.frombuffer(g.q_rows, np.int64)
            q_unit = np.zeros((len(q), dim + 1), np.float32)
            q_unit[:, :dim] = q / np.sqrt((q * q).sum(axis=1))[:, None]
            found = graph.nearest(q_unit, width)
            for i in range(len(q)):
                at = found[i][found[i] >= 0]
                score = (v[at] * q[i]).sum(axis=1)
                if len(at) > k + 1:  # one may be the asking row's alone
                    top = score >= np.partition(score, -k - 1)[-k - 1]
                    at, score = at[top], score[top]
                n = firsts[at + 1] - firsts[at]
                member = np.repeat(firsts[at + 1] - np.cumsum(n), n) + np.arange(n.sum())
                score = np.repeat(score, n)
                other = rows[member] != q_rows[i]
                member, score = member[other], score[other]
                first = np.lexsort((ids[member], -score))[:k]
                out.append((np.full(len(first), q_rows[i]), ids[member][first], score[first]))
        row, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"row": row, "vec": vec, "score": score})

    found = pairs.groupBy("dim", "shard", "block").applyInPandas(best, "row long, vec long, score double")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec"))
    ranked = found.withColumn("rank", nth).where(F.col("rank") <= k)
    return ranked.join(queries.select("row", "vec_id"), "row").select(F.col("vec_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.when(F.col("vec") != _NULL, F.col("vec")).alias("vec_id"), "score")


def nearest_neighbours(rows: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 160, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row that ``asks`` (a condition on its vec_id), its ``k`` nearest other rows by inner product: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller vec_id. Null, empty and zero vectors, and those with a null or non-finite component, take no part; only vectors of
    the same number of components meet. Repeated rows are rows of their own: each finds the others. A null id is the largest. An empty table gives no rows. Other columns are left out.
    """
    vectors = usable(rows, id_col, vector_col)
    different = points(vectors, k)
    sizes = stored(different.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest")))
    return search(index(different, sizes, shard_rows), vectors.where(asks), sizes, k, width, shard_rows)
