"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

#: Vectors of a block, dimensions of a column block, queries that go through the columns together.
CANDIDATES, DIMENSIONS, TILE = 4096, 16, 256
#: Bytes that a task may need for the queries that are broadcast at once, with their best so far.
QUERY_BYTES = 128 << 20
#: Rows of a buffer of vectors of all lengths.
BUFFER = 1 << 16
BLOCK = "ask boolean, key long, d int, n int, most double, kind string, ids binary, columns binary"


def takes_part(vector: Column) -> Column:
    """False for null vectors and those with a null or non-finite component."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return ~F.coalesce(odd, F.lit(True))


def _packed(ask: bool, ids: list, rows: list) -> dict:
    """A block in vertical layout: dimension by dimension, in the smallest type that holds it."""
    x = np.array(rows, dtype=np.float64).reshape(len(rows), len(rows[0])).T
    most = float(np.abs(x).max()) if x.size else 0.0
    kind = next((k for k, m in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if most <= m), "f8")
    raw = np.array(ids, dtype=np.int64).tobytes(), np.ascontiguousarray(x.astype(kind)).tobytes()
    return {"ask": ask, "key": xxhash.xxh64_intdigest(b"".join(raw)) >> 1, "d": x.shape[0], "n": x.shape[1], "most": most, "kind": kind, "ids": raw[0], "columns": raw[1]}


def _blocks(scale: int, size: int):
    """Rows (id, ask, x) -> blocks of at most `size` vectors of a length: all vectors, and the queries
    once more in blocks of their own."""

    def run(batches):
        held: dict[tuple, tuple[list, list]] = {}
        n, schema = 0, pa.schema([("ask", pa.bool_()), ("key", pa.int64()), ("d", pa.int32()), ("n", pa.int32()), ("most", pa.float64()), ("kind", pa.string()), ("ids", pa.binary()), ("columns", pa.binary())])

        def flush(keys):
            return pa.RecordBatch.from_pylist([_packed(k[0], *held.pop(k)) for k in keys], schema=schema)

        for batch in batches:
            ids, asks, x = batch["id"].to_pylist(), batch["ask"].to_pylist(), batch["x"]
            at, flat = x.offsets.to_numpy(), np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            for i, (vec_id, asked) in enumerate(zip(ids, asks)):
                row = flat[at[i] : at[i + 1]]
                for ask in (False, True) if asked else (False,):
                    own = held.setdefault((ask, len(row)), ([], []))
                    own[0].append(vec_id)
                    own[1].append(row)
                    n += 1
                    if len(own[0]) >= size:
                        n -= size
                        yield flush([(ask, len(row))])
                if n >= BUFFER:
                    n = 0
                    yield flush(list(held))
        if held:
            yield flush(list(held))

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids and columns (d x n, doubles) of a block."""
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["columns"], dtype=row["kind"]).reshape(row["d"], row["n"]).astype(np.float64)


def _left(columns: np.ndarray, cuts: list[slice]) -> list[np.ndarray]:
    """Mass (norm) of what follows each column block, rounded up."""
    square = [np.einsum("ij,ij->j", columns[c], columns[c]) for c in cuts]
    return [np.sqrt(x) * (1 + 1e-12) for x in np.cumsum(square[::-1], axis=0)[::-1][1:]] if square else []


class Search:
    """The k best of the blocks seen so far for queries of one length.

    A tile of queries goes through a block's columns, dimension block by dimension block. By
    Cauchy-Schwarz, what is still to come is at most the product of the two remaining masses; where
    score plus that bound stays under the query's k-th best so far, the candidate is out. Once few
    survive, each query's are compacted and only they go on.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, exact: bool, step: int = DIMENSIONS):
        self.ids, self.rows, self.k, self.exact = ids, rows, k, exact
        self.cuts = [slice(a, a + step) for a in range(0, rows.shape[1], step)]
        self.left = _left(rows.T, self.cuts)
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), best first
        self.least = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, columns: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        own = np.searchsorted(ids[order], self.ids, "left"), np.searchsorted(ids[order], self.ids, "right")
        norms = np.sqrt(np.einsum("ij,ij->j", columns, columns)) * (1 + 1e-12)
        left = _left(columns, self.cuts)
        for a in range(0, len(self.ids), TILE):
            tile = slice(a, min(a + TILE, len(self.ids)))
            score = np.zeros((tile.stop - a, len(ids)))
            for i in np.flatnonzero(own[0][tile] < own[1][tile]):
                score[i, order[own[0][a + i] : own[1][a + i]]] = -np.inf
            survivors = None
            for b, cut in enumerate(self.cuts):
                score += self.rows[tile, cut] @ columns[cut]
                if self.exact and b < len(left) and np.isfinite(self.least[tile]).all():
                    alive = score + np.outer(self.left[b][tile], left[b]) >= self.least[tile, None]
                    if alive.mean() < 1 / 8:
                        survivors = [np.flatnonzero(x) for x in alive]
                        break
            for i in range(tile.stop - a):
                q = a + i
                if survivors is not None:
                    at = survivors[i]
                    made = score[i, at] + self.rows[q, cut.stop :] @ columns[cut.stop :, at]
                else:
                    at, made = np.arange(len(ids)), score[i]
                self._keep(q, at, made, ids, columns, norms)

    def _keep(self, q: int, at: np.ndarray, made: np.ndarray, ids: np.ndarray, columns: np.ndarray, norms: np.ndarray) -> None:
        stay = made > -np.inf
        # without exact sums, each may be off by the rounding of its terms
        off = 0.0 if self.exact else (len(columns) + 4) * 2.0**-51 * np.sqrt(self.rows[q] @ self.rows[q]) * norms[at]
        if not self.exact:
            stay &= ids[at] != self.ids[q]
            off = np.nan_to_num(off, nan=np.inf)
        stay &= made + off >= self.least[q]
        at, made, off = at[stay], made[stay], off if self.exact else off[stay]
        if len(at) > self.k:
            low = made - off
            stay = made + off >= np.partition(low, len(at) - self.k)[len(at) - self.k]
            at, made = at[stay], made[stay]
        if not len(at):
            return
        if self.exact:
            new = zip((-made).astype(np.int64).tolist(), ids[at].tolist())
        else:
            own = [int(x) for x in self.rows[q]]
            new = ((-sum(x * int(y) for x, y in zip(own, columns[:, j])), int(ids[j])) for j in at)
        self.found[q] = sorted([*self.found[q], *new])[: self.k]
        if len(self.found[q]) == self.k:
            least = -self.found[q][-1][0]
            self.least[q] = least if self.exact else float(least) - abs(float(least)) * 2.0**-52


def _searched(queries, k: int, exact: bool):
    """Blocks -> each query's k best of this task's."""

    def run(batches):
        asked: dict[int, Search] = {}
        for d, parts in queries.value.items():
            ids, rows = zip(*map(_unpacked, parts))
            asked[d] = Search(np.concatenate(ids), np.concatenate([r.T for r in rows]), k, exact)
        for batch in batches:
            for row in batch.to_pylist():
                if row["d"] in asked:
                    asked[row["d"]].see(*_unpacked(row))
        for s in asked.values():
            for a in range(0, len(s.ids), TILE):
                rows = [(q, v, -m) for q, found in zip(s.ids[a : a + TILE].tolist(), s.found[a : a + TILE]) for m, v in found]
                if any(not -(2**63) <= x[2] < 2**63 for x in rows):
                    raise OverflowError("a score does not fit a long")
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = CANDIDATES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products of
    floor(scale * x) with every other vector of its length, ties to the smaller id; all of them if
    there are fewer.

    Vectors are written once, in blocks of vertical layout. The queries come in groups that need at
    most `query_bytes`; such a group is broadcast, every task takes it through the blocks it reads, and
    gives k rows a query. Vectors are not shuffled, and no task grows with the table.

    Scores are exact: where sums of doubles might round (from 2**53 on), they only bound, and the
    survivors are scored in whole numbers; a score that fits no long raises.

    Vectors that are null or hold a null or non-finite component, and null ids, take no part. A query
    skips every row of its own id. Repeated rows are found each; of a repeated query id each row's
    vector asks, and the k best over all its rows stay. An empty table gives no rows; other columns
    are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("ask"), F.col(vector_col).alias("x")).filter(takes_part(F.col("x")) & F.col("id").isNotNull())
    made = stage(rows.mapInArrow(_blocks(scale, block), BLOCK), "vector-blocks")
    # a row a block of queries: some thousandths of the queries' number
    listed = made.filter("ask").groupBy("d", "key").agg(F.sum("n").alias("n")).orderBy("d", "key").collect()
    spread = made.agg(F.max("most").alias("most"), F.max("d").alias("d")).first()
    exact = (spread["most"] or 0.0) ** 2 * max(1, spread["d"] or 0) < 2.0**53
    groups: list[list[int]] = []
    room = 0
    for r in listed:
        need = r["n"] * (8 * r["d"] + 128 * k)
        if not groups or need > room:
            groups.append([])
            room = query_bytes
        groups[-1].append(r["key"])
        room -= need
    spark, held, out = df.sparkSession, made.filter("not ask"), None
    for keys in groups:
        asked: dict[int, list] = {}
        for r in made.filter(F.col("ask") & F.col("key").isin(keys)).select("d", "n", "kind", "ids", "columns").collect():
            asked.setdefault(r["d"], []).append(r.asDict())
        near = held.mapInArrow(_searched(spark.sparkContext.broadcast(asked), k, exact), "query_id long, vec_id long, score long")
        near = stage(near, "nearest") if len(groups) > 1 else near
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
