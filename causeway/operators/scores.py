"""Exact inner products of many queries with many vectors, in blocks of matrices, and the best of each query.

Products of whole blocks only choose: whatever they cannot exclude is scored again component by component, in doubles and in
order, so a score does not depend on where a row lies and equal vectors have equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and vectors whose products are taken at once, and products that are scored again at once.
QUERIES, VECTORS, AGAIN = 512, 2048, 1 << 16
#: Longest queries and vectors whose products are taken in single precision; others are taken in doubles.
SINGLE = 1e6


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two matrices, their components added from first to last."""
    out = np.zeros(len(a))
    for at in range(a.shape[1]):
        out += a[:, at] * b[:, at]
    return out


class Best:
    """The ``k`` best vectors of each query among those added: greatest products first, then least ids; a query's own id is none.

    ``names`` are the queries' ids; rows to add have a column ``name`` of that type, ``vec_id``, and others that come along.
    """

    def __init__(self, names: pa.Array, queries: np.ndarray, k: int):
        self.names, self.queries, self.k = names, queries, k
        self.codes = pc.index_in(names, names.unique()).to_numpy()
        self.lengths = np.sqrt((queries * queries).sum(1))
        self.single = queries.astype(np.float32) if self.lengths.max(initial=0.0) < SINGLE else None
        self.least = np.full(len(queries), -np.inf)
        self.parts: list[pa.Table] = []
        self.held, self.room = 0, 1 << 17

    def add(self, rows: pa.Table, vectors: np.ndarray, meant: np.ndarray | None = None) -> None:
        """Add finite vectors; ``meant`` are the numbers of the queries that are asked of them, all without it."""
        meant = np.arange(len(self.queries)) if meant is None else meant
        for low in range(0, len(vectors), VECTORS):
            here, block = rows.slice(low, VECTORS), vectors[low : low + VECTORS]
            own = pc.index_in(here["name"].combine_chunks(), self.names.unique()).fill_null(-1).to_numpy()
            at_own = np.flatnonzero(own >= 0)
            longest = np.sqrt((block * block).sum(1).max(initial=0.0))
            for at in range(0, len(meant), QUERIES):
                self._choose(meant[at : at + QUERIES], here, block, own, at_own, longest)

    def _choose(self, asked, here, block, own, at_own, longest) -> None:
        """Keep the pairs that the products of a block cannot exclude: a product differs from its score by less than ``slack``."""
        if single := self.single is not None and longest < SINGLE:
            products = self.single[asked] @ block.astype(np.float32).T
        else:
            products = self.queries[asked] @ block.T
        # more than two orders of adding, and roundings of the components, can differ by; at last what numbers near 0 lose
        slack = (1.3e-7 if single else 1e-15) * (block.shape[1] + 4) * self.lengths[asked] * longest + (1e-25 if single else 0.0)
        if self.k < len(block) and np.isneginf(self.least[asked]).any():
            if len(at_own):
                products[:, at_own] = np.where(self.codes[asked][:, None] == own[at_own], -np.inf, products[:, at_own])
            nth = np.partition(products, len(block) - self.k, axis=1)[:, len(block) - self.k]
            self.least[asked] = np.maximum(self.least[asked], nth - slack)
        bound = np.nextafter((self.least[asked] - slack).astype(products.dtype), -np.inf, dtype=products.dtype)
        # most queries have no pair to keep in most blocks; doubles of any length may overflow, and a row's maximum is then no number
        hit = np.flatnonzero(products.max(1) >= bound) if single else np.arange(len(asked))
        q, v = np.divmod(np.flatnonzero(products[hit] >= bound[hit][:, None]), len(block))
        q = hit[q]
        other = self.codes[asked[q]] != own[v]
        q, v = q[other], v[other]
        for cut in range(0, len(q), AGAIN):
            self._keep(asked[q[cut : cut + AGAIN]], v[cut : cut + AGAIN], here, block)

    def _keep(self, q: np.ndarray, v: np.ndarray, rows: pa.Table, block: np.ndarray) -> None:
        score = in_order(self.queries[q], block[v])
        good = score >= self.least[q]
        q, v, score = q[good], v[good], score[good]
        self.parts.append(rows.take(pa.array(v)).append_column("q", pa.array(q)).append_column("score", pa.array(score)))
        self.held += len(q)
        if self.held > self.room:
            self._cut()

    def _cut(self) -> None:
        """Only the best of each query stay; the last of them is the least that others have to reach."""
        every = pa.concat_tables(self.parts)
        every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), ("vec_id", "ascending")]))
        q = every["q"].to_numpy()
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = np.flatnonzero(place == self.k - 1)
        self.least[q[last]] = np.maximum(self.least[q[last]], every["score"].to_numpy()[last])
        kept = every.take(pa.array(np.flatnonzero(place < self.k))).combine_chunks()
        self.parts, self.held = [kept], len(kept)
        self.room = max(1 << 17, 2 * len(kept))

    def rows(self) -> pa.Table | None:
        """q, the number of the query, score and the columns of the rows of the best."""
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]


def matrix(column) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def best(names, ids, queries, k: int, blocks):
    """query_id, vec_id, ok, score of the best of each query, as record batches, where ``blocks`` are (rows, vectors, numbers of queries)."""
    found = Best(names, queries, k)
    for rows, vectors, meant in blocks:
        found.add(rows, vectors, meant)
    table = found.rows()
    if table is not None:
        table = pa.table({"query_id": ids.take(table["q"].combine_chunks()), "vec_id": table["vec_id"], "ok": table["ok"], "score": table["score"]})
        yield from table.to_batches(max_chunksize=10_000)
