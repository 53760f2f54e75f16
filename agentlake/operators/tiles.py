"""All pairs of two tables' rows of a user, tile by tile: products of blocks in bounded memory, dealt to all tasks.

Rows have user_id, id and ``load``, a list: numbers of a vector, or terms without repeats.  A user's rows are dealt into parts
of at most about ``PART`` rows and ``ITEMS`` items of their lists; each part of the one side meets each of the other in a task of
its own.  So a row is copied once for each part of the other side, and no pair leaves its task unless it is asked for.  Users
that are null meet nobody.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Rows and list items of a part; pairs that a task scores at once; terms that are multiplied as columns of a matrix at most.
PART, ITEMS, CELLS, COLUMNS = 8_192, 1 << 20, 1 << 19, 1_024

_KEYS = ["user_id", "block", "part"]


def _parts(rows: DataFrame, name: str, most: int) -> DataFrame:
    """user_id and the number of its parts, of users that have several: at most a row for each ``most`` rows or ``ITEMS`` items."""
    n = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum(F.greatest(F.size("load"), F.lit(0))) / ITEMS)).cast("int")
    return F.broadcast(rows.where("user_id is not null").groupBy("user_id").agg(n.alias(name)).where(f"{name} > 1"))


def _own(rows: DataFrame, parts: str) -> DataFrame:
    return rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col(parts)).cast("int"))


def _each(copies: DataFrame, work: Callable, schema: str) -> DataFrame:
    session = copies.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("id")
        left, right = (rows.filter(pc.equal(rows["side"], side)) for side in (0, 1))
        alone = key[1].as_py() == key[2].as_py()
        yield from (x.cast(out) if x.schema != out else x for x in work(key[0], left, right, alone))

    out = _arrow(session, schema)
    return copies.repartition(tasks, *_KEYS).groupBy(*_KEYS).applyInArrow(run, schema)


def _arrow(session, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(session.createDataFrame([], schema).schema)


def pairs(left: DataFrame, right: DataFrame, work: Callable, schema: str, most: int = PART) -> DataFrame:
    """What ``work`` (user_id, left rows, right rows, alone) yields as record batches of every tile of the two sides.

    Tables come sorted by id.  Both sides have the same columns, or lack what the other has.
    """
    lefts, rights = _parts(left, "lefts", most), _parts(right, "rights", most)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.where("user_id is not null").join(lefts, "user_id", "left").join(rights, "user_id", "left").fillna(1, ["lefts", "rights"])

    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = _own(counted(left), "lefts").withColumns({"side": F.lit(0), "part": others("rights")}).withColumnRenamed("own", "block")
    two = _own(counted(right), "rights").withColumns({"side": F.lit(1), "block": others("lefts")}).withColumnRenamed("own", "part")
    return _each(one.drop("lefts", "rights").unionByName(two.drop("lefts", "rights"), allowMissingColumns=True), work, schema)


def own_pairs(rows: DataFrame, work: Callable, schema: str, most: int = PART) -> DataFrame:
    """As ``pairs`` of a table with itself, each pair of parts once; a part meets itself where ``alone`` is set, and comes as left rows only."""
    dealt = _own(rows.where("user_id is not null").join(_parts(rows, "parts", most), "user_id", "left").fillna(1, ["parts"]), "parts")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = met.withColumns({"block": F.least("own", "other"), "part": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    return _each(placed.drop("parts", "own", "other"), work, schema)


def flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The items of a column of lists, and how many each row has; null is empty."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten(), pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated(value: pa.Scalar, n: int) -> pa.Array:
    return pa.repeat(value, n)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _steps(n: int, width: int, cells: int) -> Iterator[tuple[int, int]]:
    step = max(1, cells // max(1, width))
    return ((first, min(n, first + step)) for first in range(0, n, step))


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By number of places: rows, vectors and their lengths; without vectors that have no length or an unknown number."""
    items, size = flat(column)
    known, values = np.ones(len(size), bool), items.to_numpy(zero_copy_only=False).astype(float)
    if items.null_count:
        known[np.repeat(np.arange(len(size)), size)[items.is_null().to_numpy(zero_copy_only=False)]] = False
    at, out = np.cumsum(size) - size, {}
    for dim in np.unique(size[known & (size > 0)]):
        rows = np.nonzero(known & (size == dim))[0]
        stack = values.reshape(-1, dim) if len(rows) == len(size) else values[at[rows][:, None] + np.arange(dim)]
        norm = np.sqrt((stack * stack).sum(1))
        stands = ~(norm <= 0)
        out[int(dim)] = (rows[stands], stack[stands], norm[stands])
    return out


def cosines(left: pa.ChunkedArray, right: pa.ChunkedArray, cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores against all right rows), some left rows at a time; 0 beside a vector of no length, an unknown number or other places."""
    a, b = _by_length(left), _by_length(right)
    for first, last in _steps(len(left), len(right), cells):
        out = np.zeros((last - first, len(right)))
        for dim in a.keys() & b.keys():
            (rows, stack, norm), (columns, other, others) = a[dim], b[dim]
            lo, hi = np.searchsorted(rows, (first, last))
            with np.errstate(all="ignore"):
                part = stack[lo:hi] @ other.T
                part /= norm[lo:hi, None] * others
            if part.shape == out.shape:
                out = part
            else:
                out[np.ix_(rows[lo:hi] - first, columns)] = part
        yield first, out


def nearest(left: pa.ChunkedArray, right: pa.ChunkedArray, k: int, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, rounded score) of the ``k`` highest ``cosines`` of each left row, NaN above all, the lower column of equals.

    Where all vectors stand and have the same places, products of single precision tell which few can be among the first: no more than
    their error and the rounding below a k-th. Scores of these are made in double precision.
    """
    a, b = _by_length(left), _by_length(right)
    even = len(a) == len(b) == 1 and a.keys() == b.keys() and all(len(rows) == n and np.isfinite(norm).all() and norm.max() < 1e30 and norm.min() > 1e-30 for n, ((rows, _, norm),) in ((len(left), a.values()), (len(right), b.values())))
    if not even or len(right) < 64 * k:
        for first, score in cosines(left, right, cells):
            at, of, value = best(score, k)
            yield at + first, of, value
        return
    ((_, stack, norm),), ((_, other, others),) = a.values(), b.values()
    one, two = ((x / n[:, None]).astype(np.float32) for x, n in ((stack, norm), (other, others)))
    wide = len(two) // (4 * k)
    for first, last in _steps(len(one), len(two), cells):
        about = one[first:last] @ two.T
        # The k-th of the highest of 4 k stretches is no higher than the k-th of all.
        tops = about[:, : 4 * k * wide].reshape(len(about), 4 * k, wide).max(axis=2)
        least = np.partition(tops, -k, axis=1)[:, -k] - np.float32(4e-6 + stack.shape[1] * 2.5e-7)
        at, of = np.divmod(np.flatnonzero(about >= least[:, None]), len(two))
        score = np.einsum("ij,ij->i", stack[at + first], other[of]) / (norm[at + first] * others[of])
        row, column, value = _first_k(at, of, rounded(score), k)
        yield row + first, column, value


def rounded(score: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(score) * 1e6 + 0.5) / 1e6, score) + 0.0


def _first_k(row: np.ndarray, column: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first], value[first]


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of the ``k`` highest of each row, NaN above all, the lower column of equals."""
    score = np.where(np.isnan(score), np.inf, score)
    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
    # What lies further below the k-th than rounding may lift it cannot be among the first k.
    row, column = np.nonzero(score >= least[:, None] - 2e-6)
    row, column, value = _first_k(row, column, rounded(score[row, column]), k)
    return row, column, np.where(np.isinf(value), np.nan, value)


def shared(left: pa.ChunkedArray, right: pa.ChunkedArray, weights: pa.ChunkedArray | None = None, cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, number of terms shared with each right row), some left rows at a time; or the sums of the left terms' ``weights``.

    Terms that many rows of both sides have are columns of two matrices that are multiplied; the others' few pairs are counted one by one.
    """
    (one, n), (two, m) = flat(left), flat(right)
    codes = pc.dictionary_encode(pa.concat_arrays([one, two]))
    size, ids = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False)
    a, b = ids[: len(one)], ids[len(one) :]
    a_row, b_row = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    kind = np.float32 if weights is None else np.float64
    w = np.ones(len(a), kind) if weights is None else flat(weights)[0].to_numpy(zero_copy_only=False)
    met = np.bincount(a, minlength=size).astype(float) * np.bincount(b, minlength=size)
    common = np.argsort(-met, kind="stable")[:COLUMNS]
    common = common[met[common] * 200 > len(n) * len(m)]
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    x, y = np.zeros((len(n), len(common)), kind), np.zeros((len(m), len(common)), kind)
    here, there = place[a] >= 0, place[b] >= 0
    x[a_row[here], place[a[here]]] = w[here]
    y[b_row[there], place[b[there]]] = 1
    rare = ~here & (met[a] > 0)
    a, a_row, w = a[rare], a_row[rare], w[rare]
    order = np.argsort(b, kind="stable")
    b_row, had = b_row[order], np.bincount(b, minlength=size)
    begins = np.cumsum(had) - had
    for first, last in _steps(len(n), len(m), cells):
        out = x[first:last] @ y.T
        lo, hi = np.searchsorted(a_row, (first, last))
        upto = np.cumsum(had[a[lo:hi]])
        while lo < hi:
            done = upto[-1] - np.sum(had[a[lo:hi]])
            end = min(hi, lo + max(1, int(np.searchsorted(upto[len(upto) - (hi - lo) :], done + 2 * cells))))
            reps = had[a[lo:end]]
            at = np.repeat(begins[a[lo:end]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            cell = np.repeat((a_row[lo:end] - first) * len(m), reps) + b_row[at]
            more = np.bincount(cell, None if weights is None else np.repeat(w[lo:end], reps), minlength=out.size)
            out += more.reshape(out.shape).astype(kind, copy=False)
            lo = end
        yield first, out
