"""Cosines of a block of queries against a stream of vectors: matrix products find what may rank, exact sums score it."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vectors that one matrix product takes, and pairs whose exact sums are made at a time.
SLAB, PAIRS = 2048, 1 << 16
#: More than products and sums in another order can differ by.
MARGIN = 1e-10


class Vectors:
    """An array of lists: by length one matrix of doubles, the norms, and -1 as the length of what has a null."""

    def __init__(self, column: pa.Array):
        own = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(column)
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(own)[:-1]]).astype(np.int64) if len(own) else own
        self.length = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, own)
        if flat.null_count:
            self.length[np.repeat(np.arange(len(own)), own)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        self.rows, self.matrix = {}, {}
        self.place, self.norm = np.zeros(len(own), np.int64), np.full(len(own), np.nan)
        for n in np.unique(self.length[self.length >= 0]).tolist():
            rows = self.rows[n] = np.nonzero(self.length == n)[0]
            self.matrix[n] = values[first[rows][:, None] + np.arange(n)]
            self.place[rows] = np.arange(len(rows))
            self.norm[rows] = np.sqrt(_sums(self.matrix[n], self.matrix[n]))

    def units(self, n: int) -> np.ndarray:
        norms = self.norm[self.rows[n]][:, None]
        with np.errstate(all="ignore"):
            return np.where(norms > 0, self.matrix[n] / norms, 0.0)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last as functions.vectors.dot() does."""
    with np.errstate(all="ignore"):
        return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def exact(q: Vectors, r: Vectors, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, which of them are null) of the pairs ``i, j``: 0 where a vector has a null or no length, null where
    two vectors differ in length."""
    with np.errstate(all="ignore"):
        scale = q.norm[i] * r.norm[j]
    whole = (q.length[i] >= 0) & (r.length[j] >= 0)
    scaled = whole & ((scale > 0) | np.isnan(scale))
    alike = q.length[i] == r.length[j]
    out = np.zeros(len(i))
    for n in q.matrix.keys() & r.matrix.keys():
        at = np.nonzero(scaled & alike & (q.length[i] == n))[0]
        for lo in range(0, len(at), PAIRS):
            some = at[lo : lo + PAIRS]
            with np.errstate(all="ignore"):
                out[some] = _sums(q.matrix[n][q.place[i[some]]], r.matrix[n][r.place[j[some]]]) / scale[some]
    return out, scaled & ~alike


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: half up, away from zero, of the shortest decimal that tells the double."""
    with np.errstate(all="ignore"):
        scaled = np.abs(x) * 10.0**digits
        out = np.sign(x) * np.floor(scaled + 0.5) / 10.0**digits + 0.0
        half = np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5)[0]
    for k in half.tolist():
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _keys(score: np.ndarray, null: np.ndarray) -> np.ndarray:
    """What orders scores as Spark does: NaN above all, null below."""
    return np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))


def _estimates(q: Vectors, r: Vectors, units: dict[int, np.ndarray]) -> np.ndarray:
    """Keys of all pairs, within MARGIN."""
    n = next(iter(q.matrix), None)
    if len(q.matrix) == len(r.matrix) == 1 and n in r.matrix and len(r.rows[n]) == len(r.length) and len(q.rows[n]) == len(q.length):
        found = units[n] @ r.units(n).T
    else:
        scale = np.outer(np.where(q.length < 0, 0.0, q.norm), np.where(r.length < 0, 0.0, r.norm))
        found = np.where((q.length[:, None] != r.length) & (scale > 0), -np.inf, 0.0)
        for n in q.matrix.keys() & r.matrix.keys():
            found[np.ix_(q.rows[n], r.rows[n])] = units[n] @ r.units(n).T
    for row in np.nonzero((q.length >= 0) & ~np.isfinite(q.norm))[0]:
        found[row] = _keys(*exact(q, r, np.full(len(r.length), row), np.arange(len(r.length))))
    for row in np.nonzero((r.length >= 0) & ~np.isfinite(r.norm))[0]:
        found[:, row] = _keys(*exact(q, r, np.arange(len(q.length)), np.full(len(q.length), row)))
    return found


class Heads:
    """The first ``limit`` of each query of a block, by score rounded to ``digits`` and then id, so far."""

    def __init__(self, queries: pa.Array, vectors: pa.Array, limit: int, digits: int):
        self.queries, self.q, self.limit, self.digits = queries, Vectors(vectors), limit, digits
        self.units = {n: self.q.units(n) for n in self.q.matrix}
        self.least = np.full(len(queries), -np.inf)
        self.best: pa.Table | None = None

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        for lo in range(0, len(ids), SLAB):
            self._add(ids[lo : lo + SLAB], vectors[lo : lo + SLAB])

    def _add(self, ids: pa.Array, vectors: pa.Array) -> None:
        r = Vectors(vectors)
        kept = _first_copies(ids, r, self.limit)
        if len(kept) < len(ids):
            ids, r = ids.take(pa.array(kept)), Vectors(vectors.take(pa.array(kept)))
        found = _estimates(self.q, r, self.units)
        least = self.least.copy()
        if len(ids) > self.limit:
            short = np.nonzero(np.isneginf(least))[0]
            least[short] = np.partition(found[short], len(ids) - self.limit, axis=1)[:, len(ids) - self.limit]
        i, j = np.nonzero(found >= (least - MARGIN - 10.0**-self.digits)[:, None])
        if not len(i):
            return
        score, null = exact(self.q, r, i, j)
        key = _keys(rounded(score, self.digits), null)
        new = pa.table({"q": pa.array(i, pa.int64()), "key": pa.array(key), "score": pa.array(score, mask=null), "id": ids.take(pa.array(j))})
        both = new if self.best is None else pa.concat_tables([self.best, new])
        both = both.take(pc.sort_indices(both, sort_keys=[("q", "ascending"), ("key", "descending"), ("id", "ascending")], null_placement="at_start"))
        at = both.column("q").to_numpy()
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        self.best = both.filter(pa.array(nth < self.limit)).combine_chunks()
        last = nth == self.limit - 1
        self.least[at[last]] = both.column("key").to_numpy()[last]

    def rows(self) -> pa.Table | None:
        if self.best is None:
            return None
        return pa.table({"query_id": self.queries.take(self.best.column("q").combine_chunks()), "id": self.best.column("id"), "score": self.best.column("score")})


def _first_copies(ids: pa.Array, r: Vectors, limit: int) -> np.ndarray:
    """Places of the vectors, of equal ones only the ``limit`` with the least ids: no query ranks others."""
    kinds = np.zeros(len(ids), np.int64)  # 0: with a null
    n_kinds = 1
    for n, matrix in r.matrix.items():
        bits = np.ascontiguousarray(matrix).view(np.uint64)
        sums = (bits * (2 * np.arange(n, dtype=np.uint64) ** 3 + np.uint64(0x9E3779B97F4A7C15))).sum(axis=1, dtype=np.uint64)
        if n and np.unique(sums, return_counts=True)[1].max(initial=0) > limit:
            found = np.unique(np.ascontiguousarray(matrix).view(f"V{8 * n}").ravel(), return_inverse=True)[1]
        else:
            found = np.zeros(len(matrix), np.int64) if n == 0 else np.arange(len(matrix))
        kinds[r.rows[n]] = n_kinds + found
        n_kinds += len(matrix)
    if np.bincount(kinds, minlength=1).max() <= limit:
        return np.arange(len(ids))
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
    order = order[np.argsort(kinds[order], kind="stable")]
    nth = np.arange(len(order)) - np.searchsorted(kinds[order], kinds[order])
    return np.sort(order[nth < limit])


def nearest(asked: pa.Table, limit: int, digits: int, scope: list[str]):
    """A function for mapInArrow over ``id, vector`` and the ``scope`` columns: ``query_id, id, score`` of what may be
    among the first ``limit`` of the block ``asked(query_id, vector, scope...)``."""

    def parts(table) -> dict[tuple, np.ndarray]:
        """Rows by the values of their scope; a null meets nothing."""
        if not scope:
            return {(): np.arange(table.num_rows)}
        found: dict[tuple, list[int]] = {}
        for k, at in enumerate(zip(*(table.column(c).to_pylist() for c in scope), strict=True)):
            if None not in at:
                found.setdefault(at, []).append(k)
        return {at: np.array(rows) for at, rows in found.items()}

    def run(batches):
        block = asked.combine_chunks()
        heads = {}
        for at, rows in parts(block).items():
            some = block.take(pa.array(rows))
            heads[at] = Heads(some.column("query_id").combine_chunks(), some.column("vector").combine_chunks(), limit, digits)
        for batch in batches:
            for at, rows in parts(batch).items():
                if at in heads and len(rows):
                    heads[at].add(batch.column("id").take(pa.array(rows)), batch.column("vector").take(pa.array(rows)))
        for head in heads.values():
            found = head.rows()
            if found is not None:
                yield from found.to_batches()

    return run
