"""Problem 3: the k most similar vectors for every vector.

Method: randomly rotated one-bit codes. A scope that fits into a block is one
cell; the vectors of a larger one are assigned to cells of its own, around
centroids fitted on a bounded sample of it. Within a cell each vector is kept as
the packed signs of its rotated residual with two correction scalars. Inner
products are estimated from the bits and a 4-bit query, and an error bound
tells which vectors must be compared exactly.

Exact copies are one vector here, with its members joined again at the end, so
a vector that a third of all rows repeat costs no more than any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bound of the sample that the centroids are fitted on (vectors), rows aimed at for a cell, and most rows of a block of a hot cell; scopes up to a block are searched whole.
SAMPLE, CELL_ROWS, BLOCK_ROWS = 32_768, 2_048, 8_192
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 1.9
#: Where more than one in so many pairs of a block must be compared exactly, they are compared by one matrix product.
PAIRWISE = 64
SEED = 3
POPCOUNT = np.bitwise_count


def is_usable(vec: Column, dim: int) -> Column:
    """dim finite numbers, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    """Random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """k-means over the sample; an empty cell is moved to the vector worst served."""
    rng = np.random.default_rng(SEED)
    if cells <= 1 or len(sample) <= cells:
        return sample.mean(axis=0, keepdims=True) if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
    centre = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centre, 1)[:, 0]
        count = np.bincount(near, minlength=cells)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        gap = 1 - np.einsum("ij,ij->i", sample, centre[near])
        for lost, worst in zip(np.flatnonzero(count == 0), np.argsort(-gap), strict=False):
            total[lost], count[lost] = sample[worst], 1
        centre = (total / count[:, None]).astype(np.float32)
    return centre


def nearest(rows: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = np.empty((len(rows), k), np.int64)
    for s in range(0, len(rows), 4096):
        gap = (centre * centre).sum(1) - 2 * (rows[s : s + 4096] @ centre.T)
        part = np.argpartition(gap, k - 1, axis=1)[:, :k] if k < len(centre) else np.tile(np.arange(k), (len(gap), 1))
        out[s : s + 4096] = np.take_along_axis(part, np.argsort(np.take_along_axis(gap, part, 1), axis=1, kind="stable"), 1)
    return out


def pack_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    pad = -signs.shape[1] % 64
    return np.packbits(np.pad(signs, ((0, 0), (0, pad))), axis=1).view(np.uint64)


@dataclass
class Codes:
    """One-bit codes of a cell's vectors and their correction scalars."""

    bits: np.ndarray  # (n, words)
    ones: np.ndarray  # set bits of each code
    norm: np.ndarray  # length of the residual
    fit: np.ndarray  # inner product of the code and the residual's direction
    along: np.ndarray  # inner product of the vector and the centroid


def encode(rows: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
    rest = (rows - centre) @ turn.T
    norm = np.linalg.norm(rest, axis=1)
    bits = pack_bits(rest > 0)
    fit = np.abs(rest).sum(axis=1) / (np.maximum(norm, 1e-12) * math.sqrt(rows.shape[1]))
    return Codes(bits, POPCOUNT(bits).sum(axis=1).astype(np.float32), norm, np.maximum(fit, 1e-6), rows @ centre)


def estimate(codes: Codes, query: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and coded vectors, and the bound of their error."""
    dim = query.shape[1]
    rest = (query - centre) @ turn.T
    low = rest.min(axis=1, keepdims=True)
    step = np.maximum((rest.max(axis=1, keepdims=True) - low) / 15, 1e-12)
    level = np.rint((rest - low) / step).astype(np.uint8)
    planes = [pack_bits((level >> j) & 1 == 1) for j in range(4)]
    inside = np.zeros((len(query), len(codes.bits)), np.float32)
    for w in range(codes.bits.shape[1]):
        bits = codes.bits[:, w]
        low_planes, high_planes = (POPCOUNT(planes[j][:, w : w + 1] & bits) + (POPCOUNT(planes[j + 1][:, w : w + 1] & bits) << 1) for j in (0, 2))  # at most 192 each
        inside += low_planes
        inside += high_planes * np.float32(4)
    scale = codes.norm / codes.fit / np.float32(math.sqrt(dim))
    inside *= 2 * step
    inside *= scale
    of_query = np.concatenate([2 * low, -dim * low - step * level.sum(axis=1, keepdims=True), np.ones_like(low), (query @ centre)[:, None] - np.float32(centre @ centre)], axis=1, dtype=np.float32)
    inside += of_query @ np.stack([codes.ones * scale, scale, codes.along, np.ones_like(scale)]).astype(np.float32)
    spread = codes.norm * np.sqrt(np.maximum(1 - codes.fit**2, 0)) / codes.fit * (EPSILON / math.sqrt(max(dim - 1, 1)))
    return inside, np.linalg.norm(rest, axis=1)[:, None] * spread


def search_block(data: np.ndarray, query: np.ndarray, same: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, exact_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and cosines (n, k) of the best vectors for each query; index -1 where there are fewer. `same[i]` is the query's own place in data, or -1.

    The best 4k by estimate are compared exactly; every other vector whose upper bound reaches the k-th cosine found so is compared too. With exact_only all are compared, without codes.
    """
    small, turned = data.astype(np.float32), query.astype(np.float32)
    codes = None if exact_only else encode(small, centre, turn)
    index, value = np.full((len(query), k), -1), np.full((len(query), k), -2.0)
    first, take = min(4 * k, len(data)), min(k, len(data))
    for s in range(0, len(query), 256):
        q = turned[s : s + 256]
        own = same[s : s + 256]
        has = np.flatnonzero(own >= 0)
        guess, bound = (q @ small.T, None) if codes is None else estimate(codes, q, centre, turn)
        guess[has, own[has]] = -9
        many = take if codes is None else first
        seed = np.argpartition(guess, len(data) - many, axis=1)[:, len(data) - many :]
        close = np.take_along_axis(guess, seed, 1) if codes is None else np.einsum("ijd,id->ij", small[seed], q)
        close[seed == own[:, None]] = -2
        kth = np.partition(close, many - take, axis=1)[:, many - take, None]
        row, at = np.nonzero((close >= kth) & (close > -2))
        col, near = seed[row, at], close[row, at]
        if codes is not None:
            bound += guess
            np.put_along_axis(bound, seed, -9, 1)
            bound[has, own[has]] = -9
            more, there = np.divmod(np.flatnonzero(bound >= kth), len(data))
            product = q @ small.T if len(more) * PAIRWISE > bound.size else None
            for t in range(0, len(more), 65_536):
                r, c = more[t : t + 65_536], there[t : t + 65_536]
                exact = np.einsum("ij,ij->i", small[c], q[r]) if product is None else product[r, c]
                better = exact >= kth[r, 0]
                row, col, near = np.concatenate([row, r[better]]), np.concatenate([col, c[better]]), np.concatenate([near, exact[better]])
        order = np.lexsort((-near, row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, rank = row[rank < take], col[rank < take], rank[rank < take]
        index[s + row, rank], value[s + row, rank] = col, np.einsum("ij,ij->i", data[col], query[s + row])
    return index, value


def probes_of(cells: int) -> int:
    """Cells of a scope searched for each vector: 6 up to 64 cells, two more with each doubling."""
    return min(cells, max(6, math.ceil(2 * math.log2(max(cells, 1))) - 6))


def probed(at: np.ndarray, rows: np.ndarray, centre: np.ndarray, counts: np.ndarray, probes: int | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's home, for each cell that a row of a scope searches: the nearest `probes`, and more of them where these hold fewer than k others."""
    n = min(len(centre), probes or probes_of(len(centre)))
    cell = nearest(rows, centre, n)
    out = [(np.repeat(at, n), cell.ravel(), np.tile(np.arange(n) == 0, len(at)))]
    for i in np.flatnonzero(counts[cell].sum(axis=1) <= k):
        order = nearest(rows[i : i + 1], centre, len(centre))[0]
        more = order[n : np.searchsorted(np.cumsum(counts[order]), k, "right") + 1]
        out.append((np.repeat(at[i], len(more)), more, np.zeros(len(more), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _fit(base: DataFrame, sizes: dict[str, int], cells: int | None, dim: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Centroids of each scope in `sizes`, and how many different vectors have each of its cells as their home."""
    share = min(1.0, SAMPLE / sum(sizes.values()))
    spark = base.sparkSession
    base = base.join(F.broadcast(spark.createDataFrame([(s,) for s in sizes], "scope string")), "scope", "left_semi")
    drawn = base.filter(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).groupBy("scope", "h1", "h2").agg(F.first("vec").alias("vec")).select("scope", "vec").toArrow()
    scopes = np.array(drawn["scope"].to_pylist(), object)
    sample = unit(np.array(drawn["vec"].combine_chunks().flatten(), np.float32).reshape(-1, dim)).astype(np.float32) if len(drawn) else np.zeros((0, dim), np.float32)
    centres = {s: fit_centroids(sample[scopes == s], max(1, min(cells or round(n / CELL_ROWS), int((scopes == s).sum()) // 16))) for s, n in sizes.items()}
    shared = spark.sparkContext.broadcast(centres)

    def homes(batches):
        for b in batches:
            scope = b["scope"].dictionary_encode()
            of, cell = np.array(scope.indices), np.zeros(len(b), np.int64)
            raw = np.array(b["vec"].flatten(), np.float32).reshape(-1, dim)
            for i, s in enumerate(scope.dictionary.to_pylist()):
                cell[of == i] = nearest(unit(raw[of == i]).astype(np.float32), shared.value[s], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b["scope"], pa.array(cell, pa.int32()), b["h1"], b["h2"]], names=["scope", "cell", "h1", "h2"])

    counts = {s: np.zeros(len(c), np.int64) for s, c in centres.items()}
    found = base.select("scope", "h1", "h2", "vec").mapInArrow(homes, "scope string, cell int, h1 long, h2 long").distinct().groupBy("scope", "cell").count()
    for r in found.collect():
        counts[r.scope][r.cell] = r["count"]
    return centres, counts


def nearest_vectors(df: DataFrame, scope_col: str, id_col: str, vec_col: str, dim: int = 64, k: int = 5, min_cosine: float = -1.0, cells: int | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
    """For every usable vector the k most similar others of its scope: columns scope, id, neighbour, cosine, rank.

    Vectors that are null, of another length than dim, not finite or all zero take no part; null scopes form a scope of their own, rows with a null id are left out. Repeated rows (same
    id and vector) count once. Cosines below min_cosine are left out. Equal cosines are ranked by id; between different vectors at exactly the k-th cosine within a cell the choice is by place.
    Copies of a vector are each other's neighbours at cosine 1. A scope with k others or fewer gives what there is; an empty table gives no rows. Columns besides the three are left out.
    Approximate in scopes of more than BLOCK_ROWS different vectors, of which `probes` of `cells` cells are searched (default by size of the scope) and further ones, nearest first, while they hold
    fewer than k others. Smaller scopes are one cell, where the result differs from brute force only where the error bound fails. With `cells` given, scopes of up to 16 vectors a cell are one cell. `exact` is the exact way for scopes of any size:
    each is one cell, cut into blocks of which every pair is compared in full, at a cost that grows with the square of the scope.
    """
    spark = df.sparkSession
    base = (
        df.select(F.coalesce(df[scope_col], F.lit("")).alias("scope"), df[id_col].alias("id"), df[vec_col].cast("array<float>").alias("vec"))
        .filter(is_usable(F.col("vec"), dim) & F.col("id").isNotNull())
        .withColumn("h1", F.xxhash64(F.lit(1), "vec")).withColumn("h2", F.xxhash64(F.lit(2), "vec"))
    )
    keys = base.select("scope", "h1", "h2").distinct()
    cells, probes = (1, 1) if exact else (cells, probes)
    whole = min(BLOCK_ROWS, 16 * cells) if cells else BLOCK_ROWS
    sizes = {r.scope: r.n for r in keys.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole).collect()}  # at most one in `whole` vectors
    turn = rotation(dim)
    centres, counts = _fit(base, sizes, cells, dim) if sizes else ({}, {})
    shared = spark.sparkContext.broadcast((centres, counts))  # at most SAMPLE / 16 centroids besides one for each of these scopes

    vectors = base.groupBy("scope", "h1", "h2").agg(F.first("vec").alias("vec"))
    placed_type = "scope string, cell int, block int, kind int, h1 long, h2 long, vec binary"

    def place(batches):
        centres, counts = shared.value
        for b in batches:
            if not len(b):
                continue
            raw = np.ascontiguousarray(np.array(b["vec"].flatten(), np.float32).reshape(-1, dim))
            h2 = np.array(b["h2"])
            scope = b["scope"].dictionary_encode()
            names, of = scope.dictionary.to_pylist(), np.array(scope.indices)
            large = [i for i, s in enumerate(names) if s in centres]
            alone = np.flatnonzero(~np.isin(of, large))
            rows = [np.stack([alone, 0 * alone, 0 * alone, 0 * alone + 3])]  # (row, cell, block, kind): kind 1 is searched, 2 searches, 3 both
            for g in large:
                at, cell, first = probed(np.flatnonzero(of == g), unit(raw[of == g]).astype(np.float32), centres[names[g]], counts[names[g]], probes, k)
                parts = np.maximum(1, -(-counts[names[g]][cell] // BLOCK_ROWS))
                for p in np.unique(parts):
                    i, c, home, many = at[parts == p], cell[parts == p], first[parts == p], np.arange(p)
                    if p == 1:
                        rows.append(np.stack([i, c, 0 * i, np.where(home, 3, 2)]))
                        continue
                    own, seek = h2[i] % p, (h2[i] >> 20) % p
                    rows.append(np.stack([np.repeat(i, p), np.repeat(c, p), (many * p + seek[:, None]).ravel(), np.repeat(0 * i + 2, p)]))
                    rows.append(np.stack([np.repeat(i[home], p), np.repeat(c[home], p), (own[home, None] * p + many).ravel(), np.repeat(0 * i[home] + 1, p)]))
            at, to, block, kind = np.concatenate(rows, axis=1)
            take = pa.array(at)
            binary = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, len(raw) * dim * 4 + 1, dim * 4, dtype=np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [b["scope"].take(take), pa.array(to, pa.int32()), pa.array(block, pa.int32()), pa.array(kind, pa.int32()), b["h1"].take(take), b["h2"].take(take), binary.take(take)],
                names=["scope", "cell", "block", "kind", "h1", "h2", "vec"],
            )

    found_type = "scope string, h1 long, h2 long, near array<struct<cosine:double,h1:long,h2:long>>"

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        kind, h1, h2 = np.array(t["kind"]), np.array(t["h1"]), np.array(t["h2"])
        rows = unit(np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(-1, dim))
        there, asks = np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
        if not len(there):
            asks = asks[:0]
        place_of = {(a, b): i for i, (a, b) in enumerate(zip(h1[there].tolist(), h2[there].tolist(), strict=True))}
        same = np.array([place_of.get(x, -1) for x in zip(h1[asks].tolist(), h2[asks].tolist(), strict=True)], np.int64)
        index, value = search_block(rows[there], rows[asks], same, rows[there].mean(axis=0).astype(np.float32), turn, k, exact) if len(asks) else (np.zeros((0, k), np.int64), np.zeros((0, k)))
        keep = (index >= 0) & (value >= min_cosine)
        some = np.flatnonzero(keep.any(axis=1))
        which = there[index[keep]]
        near = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(keep[some].sum(axis=1))]), pa.int32()),
            pa.StructArray.from_arrays([pa.array(np.minimum(value[keep], 1.0)), pa.array(h1[which]), pa.array(h2[which])], names=["cosine", "h1", "h2"]),
        )
        return pa.table({"scope": t["scope"].take(pa.array(asks[some])), "h1": h1[asks[some]], "h2": h2[asks[some]], "near": near})

    placed = vectors.mapInArrow(place, placed_type)
    partial = placed.groupBy("scope", "cell", "block").applyInArrow(search, found_type)
    merged = partial.groupBy("scope", "h1", "h2").agg(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("near")))), 1, k).alias("near"))

    members = base.select("scope", "h1", "h2", "id").distinct()
    by = W.partitionBy("scope", "h1", "h2").orderBy("id")
    some = members.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1).groupBy("scope", "h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    other = merged.select("scope", "h1", "h2", F.explode("near").alias("x")).select("scope", "h1", "h2", "x.cosine", F.col("x.h1").alias("n1"), F.col("x.h2").alias("n2"))
    other = other.join(some.select("scope", F.col("h1").alias("n1"), F.col("h2").alias("n2"), "ids"), ["scope", "n1", "n2"]).select("scope", "h1", "h2", "cosine", "ids")
    own = some.filter(F.size("ids") > 1).select("scope", "h1", "h2", F.lit(1.0).alias("cosine"), "ids")
    ranked = (
        other.unionByName(own).select("scope", "h1", "h2", "cosine", F.explode("ids").alias("id"))
        .groupBy("scope", "h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "id"))).alias("near"))
    )
    return (
        members.join(ranked, ["scope", "h1", "h2"])
        .select("scope", "id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("pos", "x"))
        .select("scope", "id", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
    )
