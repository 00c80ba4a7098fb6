"""Exact search of a stated set of queries by reading the rows once, where they lie: blocks of rows meet blocks of queries as matrices, and only the best of each task move on."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries compared at a time in a task, and rows.
SUB, ROWS = 512, 4_096
#: Rows of all scopes that wait in a task for their block to fill.
WAITING = 8 * ROWS
#: Rows that are broadcast, after they were counted: digests of keys, and keys.
DIGESTS, KEYS = 1_000_000, 200_000


def broadcast_few(rows: DataFrame, most: int = KEYS) -> DataFrame:
    """Rows to be broadcast if there are at most so many. These are fetched at once, so that what they are made from is not read again."""
    held = rows.limit(most + 1).toArrow()
    return F.broadcast(rows.sparkSession.createDataFrame(held, rows.schema)) if held.num_rows <= most else rows


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """Rows where they lie, read by two tasks a core at most: each task passes on the best of every query, so more tasks than that only shuffle more."""
    return rows.coalesce(max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def once_and_again(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key comes once, and the others (and the few that share a digest with them, so they must still be grouped by the key itself). Only digests of keys are shuffled, so wide rows stay where they are."""
    digest = F.xxhash64(*keys)
    again = broadcast_few(rows.select(digest.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"), DIGESTS)
    named = rows.withColumn("_key", digest)
    return named.join(again, "_key", "left_anti").drop("_key"), named.join(again, "_key", "left_semi").drop("_key")


def scopes(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """A table cut by its column scope."""
    named = table["scope"].combine_chunks().dictionary_encode()
    codes, names = named.indices.to_numpy(zero_copy_only=False), named.dictionary.to_pylist()
    if len(names) > 1:
        order = np.argsort(codes, kind="stable")
        table, codes = table.take(pa.array(order)), codes[order]
    ends = np.searchsorted(codes, np.arange(len(names) + 1))
    for n, name in enumerate(names):
        yield name, table.slice(int(ends[n]), int(ends[n + 1] - ends[n]))


def by_scope(batches: Iterator[pa.RecordBatch], known: Collection[str], rows: int = ROWS) -> Iterator[tuple[str, pa.Table]]:
    """(scope, table) of at most `rows` rows of one scope each; rows of scopes that aren't known are passed over."""
    held: dict[str, list[pa.Table]] = {}
    size: dict[str, int] = {}

    def whole(scope: str) -> tuple[str, pa.Table]:
        del size[scope]
        return scope, pa.concat_tables(held.pop(scope))

    for batch in batches:
        for scope, part in scopes(pa.Table.from_batches([batch])):
            while scope in known and part.num_rows:
                most = min(part.num_rows, rows - size.get(scope, 0))
                held.setdefault(scope, []).append(part.slice(0, most))
                size[scope] = size.get(scope, 0) + most
                part = part.slice(most)
                if size[scope] == rows:
                    yield whole(scope)
        while sum(size.values()) > WAITING:
            yield whole(max(size, key=size.get))
    for scope in list(size):
        yield whole(scope)


class Best:
    """The k best rows of each of a number of queries, as blocks of rows come: by score, to six decimals, then by the smaller id."""

    def __init__(self, queries: int, k: int, above: float = -np.inf) -> None:
        self.k, self.above = k, above
        self.least = np.full(queries, -np.inf)
        self.held: dict[int, pa.Table] = {}

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of the queries from number `first` on (rows) for ids in ascending order (columns). The same blocks of queries must come each time."""
        many, n = scores.shape
        bar = self.least[first : first + many]
        if self.k < n and np.isinf(bar).any():
            bar = np.maximum(bar, np.round(np.partition(scores, n - self.k, axis=1)[:, n - self.k], 6))
        row, col = np.nonzero(scores > np.maximum(bar - 1e-6, self.above)[:, None])
        value = np.round(scores[row, col], 6)
        keep = (value >= bar[row]) & (value > self.above)
        row, col, value = row[keep], col[keep], value[keep]
        if not len(row):
            return
        order = np.lexsort((col, -value, row))
        row, col, value = row[order], col[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        row, col, value = row[keep], col[keep], value[keep]
        new = pa.table({"query": row, "id": ids.take(pa.array(col)), "score": value})
        if first in self.held:
            new = pa.concat_tables([self.held[first], new])
            new = new.take(pc.sort_indices(new, [("query", "ascending"), ("score", "descending"), ("id", "ascending")]))
            row = new["query"].to_numpy()
            new = new.take(pa.array(np.nonzero(np.arange(len(row)) - np.searchsorted(row, row) < self.k)[0])).combine_chunks()
        self.held[first] = new
        row = new["query"].to_numpy()
        ends = np.searchsorted(row, np.arange(many), "right")
        full = ends - np.searchsorted(row, np.arange(many)) == self.k
        self.least[first : first + many][full] = new["score"].to_numpy()[ends[full] - 1]

    def rows(self, names: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        """(query_id, id, name) of what is held; `names` has the queries' ids by number."""
        for first, held in self.held.items():
            at = pa.array(held["query"].to_numpy() + first)
            table = pa.table({"query_id": names.take(at), "id": held["id"], name: held["score"]}).combine_chunks()
            yield from table.to_batches()
