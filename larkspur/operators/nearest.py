"""Exact nearest rows and greatest cosines, by blocks of vectors and in bounded memory.

Vectors are packed into rows of some thousands, in the checkpoint folder. Each task streams all
packed rows past its own few (a cartesian product whose streamed side is one partition), so no
vector passes through the driver and a worker holds its own packed rows, one more and one product
at a time. Of a pair of packed rows only what the worker does not have yet is sent to it. A product
of matrices, of single precision where that can't overflow, bounds each distance from below, and
only pairs that the bound leaves in question are computed again, as a left fold in the order of
functions/vectors.py: results are those of the expressions there, bit for bit. The work is
quadratic, memory is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import vectors as V
from larkspur.session import cut

#: Rows packed together at most, of a bank at once, columns and rows of a product (which stays in a core's cache).
CHUNK_ROWS, BLOCK_ROWS, TILE, STRIP = 8_192, 8_192, 2_048, 512
#: Pairs that are looked up at once, that are held before they are computed again, and of these at once (whose vectors stay in the cache too).
PAIRS, FEW, FOLD = 1 << 20, 1 << 14, 1 << 10
#: Rows of a task at least and at a large size, and tasks that there are before they grow beyond the least.
LEAST_ROWS, TASK_ROWS, TASKS = 256, 32_768, 24
#: More than any packed row has; positions are its id times this, plus the place in it.
MOST_ROWS = 1 << 14
#: In place of distances: to vectors with NaN, which come after all others, and to null, which come last.
NAN_AT, NULL_AT = 1e150, 2e150
NO_LABEL = -(1 << 63)
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors (zeros for those that are null or not finite) and their states: 0, 1 not finite, 2 null."""
    state = np.where(column.is_valid().to_numpy(zero_copy_only=False), 0, 2).astype(np.int8)
    there = state == 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = len(flat) // max(1, there.sum())
    lengths = column.drop_null().value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError("vectors differ in length")
    m = np.zeros((len(column), dim))
    if there.any():
        m[there] = flat.reshape(-1, dim)
    finite = np.isfinite(m).all(axis=1)
    state[~finite] = 1
    m[~finite] = 0.0
    return m, state


def _code(label: Column | None, kind: T.DataType | None) -> Column:
    """label as a long; other types than integers by a hash of 64 bits."""
    if label is None:
        return F.lit(0).cast("long")
    as_long = label.cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(label)
    return F.when(label.isNull(), F.lit(NO_LABEL)).otherwise(as_long)


def _packed(batches):
    part, n, before = TaskContext.get().partitionId() << 24, 0, None
    for whole in batches:
        for at, end in _even(0, whole.num_rows, CHUNK_ROWS):
            b = whole.slice(at, end - at)
            m, state = matrix(b.column(3))
            labels, kinds = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            keys = pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(0))
            raw = (pa.array([x.tobytes()], pa.binary()) for x in (labels, kinds, state, m))
            yield pa.RecordBatch.from_arrays([pa.array([part + n]), pa.array(labels[:1]), pa.array(labels[-1:]), pa.array([before], pa.int64()), keys, *raw], names=["chunk", "least", "most", "before", "keys", "labels", "kinds", "state", "vectors"])
            n, before = n + 1, int(labels[-1])


def _parts(rows: int) -> int:
    return max(1, -(-rows // min(TASK_ROWS, max(LEAST_ROWS, -(-rows // TASKS)))))


def _even(start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of start to end of much the same length, most at most."""
    step = -(-(end - start) // max(1, -(-(end - start) // most)))
    return ((at, min(at + step, end)) for at in range(start, end, max(1, step)))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of few packed rows to Python workers, while a query runs."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, "8m")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def _streamed(packed: DataFrame, asked: DataFrame, on: Column | None = None) -> DataFrame:
    """Each row of asked with all of packed; a task has a partition of asked and reads packed row by row.

    `first` marks the packed row that each task reads first, whatever `on` says of it.
    """
    streamed = packed.coalesce(1).withColumn("first", F.monotonically_increasing_id() == 0)
    return streamed.hint("shuffle_replicate_nl").join(asked, on if on is None else F.col("first") | on)


def _of(state, vectors) -> tuple[np.ndarray, np.ndarray]:
    state = np.frombuffer(state, np.int8)
    return np.frombuffer(vectors, np.float64).reshape(len(state), -1), state


def _pairs(x: np.ndarray, r: np.ndarray, y: np.ndarray, c: np.ndarray, distance: bool) -> np.ndarray:
    """Left folds over the dimensions, for the pairs of rows r of x and c of y."""
    out = np.zeros(len(r))
    for at in range(0, len(r), FOLD):
        a, b = x[r[at : at + FOLD]], y[c[at : at + FOLD]]
        if distance:
            a -= b
            a *= a
        else:
            a *= b
        for each in a.T:
            out[at : at + FOLD] += each
    return np.sqrt(out) if distance else out


_room: dict[np.dtype, np.ndarray] = {}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in memory that the next call takes again: fresh pages cost as much as a tenth of the product."""
    n = len(a) * b.shape[1]
    if len(_room.get(a.dtype, ())) < n:
        _room[a.dtype] = np.empty(n, a.dtype)
    return np.matmul(a, b, out=_room[a.dtype][:n].reshape(len(a), b.shape[1]))


def _margin(dim: int, squares: np.ndarray, most: float, kind: np.dtype) -> np.ndarray:
    """More than twice what a product of matrices of that precision can be off a left fold."""
    return 4 * (dim + 4) * np.finfo(kind).eps * (squares + most)


def _slices(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, len(mask) if np.count_nonzero(mask) <= PAIRS else PAIRS // mask.shape[1])
    for at in range(0, len(mask), step):
        r, c = np.divmod(np.flatnonzero(mask[at : at + step]), mask.shape[1])
        if len(r):
            yield r + at, c


def _great(g: np.ndarray, k: int) -> np.ndarray:
    """Of each row a value that k columns reach: the k-th of the greatest of parts, which is cheaper than the k-th of all."""
    width = g.shape[1] // (parts := 12 * k)
    if width > 1:
        g = g[:, : parts * width].reshape(len(g), width, parts).max(axis=1)
    return np.partition(g, g.shape[1] - k, axis=1)[:, -k]


class _Side:
    """Vectors with what the search derives from them once."""

    def __init__(self, m: np.ndarray, state: np.ndarray):
        self.m, self.state = m, state
        self.squares = (m * m).sum(axis=1)
        self.most = float(self.squares.max(initial=0.0))
        self.codes = np.array([0.0, NAN_AT, NULL_AT])[state]
        self._wide: dict[type, np.ndarray] = {}

    def fitted(self, other: _Side) -> _Side:
        """With the other's length of vectors: rows of nulls alone have none."""
        mine, dim = self.m.shape[1], other.m.shape[1]
        if mine and dim and mine != dim:
            raise ValueError("vectors differ in length")
        return self if mine >= dim else _Side(np.zeros((len(self.m), dim)), self.state)

    def precision(self, other: _Side) -> type:
        """Single where squares neither overflow nor vanish in it."""
        return np.float32 if 1e-20 < self.most < 1e30 and other.most < 1e30 else np.float64

    def wide(self, kind: type) -> np.ndarray:
        """A column more, of -|y|^2 / 2; far below all others for rows without a vector. Column by column in memory."""
        if kind not in self._wide:
            last = -np.where(self.state > 0, self.codes * self.codes, self.squares)[:, None] / 2
            self._wide[kind] = np.asfortranarray(np.hstack([self.m, np.maximum(last, -1e38 if kind == np.float32 else last)]).astype(kind))
        return self._wide[kind]


class _Best:
    """The k nearest of each row of a chunk: distance, position and kind, by distance and position."""

    def __init__(self, q: _Side, start: int, k: int):
        n = len(q.m)
        self.q, self.k = q, k
        self.at = start + np.arange(n)
        self.d, self.i, self.kind = np.full((n, k), np.inf), np.full((n, k), -1), np.full((n, k), NO_LABEL)
        self.wide: dict[type, np.ndarray] = {}

    def distances(self, r, y: _Side, c) -> np.ndarray:
        return np.where(y.state[c] > 0, y.codes[c], _pairs(self.q.m, r, y.m, c, True))

    def see(self, rows: np.ndarray, y: _Side, wide: np.ndarray, first: int, lo: int, hi: int, kinds: np.ndarray) -> None:
        """Columns lo to hi of y, of which the first stands at position `first`, in the precision of wide.

        Pairs in question are folded and merged after several products, as few at once cost more than the products save.
        """
        if wide.dtype not in self.wide:
            self.wide[wide.dtype] = np.hstack([self.q.m, np.ones((len(self.q.m), 1))]).astype(wide.dtype)
        rows = rows[~self._late(rows, first + lo) & (self.q.state[rows] == 0)]
        if not len(rows):
            return
        x, kth = self.wide[wide.dtype][rows], self.d[rows, -1].copy()
        low, asked, n = self._low(rows, kth, y, wide.dtype), [], 0
        for t, end in _even(lo, hi, TILE):
            g = _product(x, wide[t:end].T)  # dot - |y|^2 / 2
            own = self.at[rows] - first - t
            mine = np.flatnonzero((own >= 0) & (own < end - t))
            g[mine, own[mine]] = -np.inf
            if t == lo and end - t > self.k + 1 and len(new := np.flatnonzero(np.isinf(kth))):
                low[new] = np.maximum(_great(g[new], self.k) - _margin(y.m.shape[1], self.q.squares[rows[new]], y.most, wide.dtype), low[new])
            hot = np.flatnonzero(g.max(axis=1) >= low)
            for r, c in _slices(g[hot] >= low[hot, None]):
                asked.append((hot[r], c + t))
                n += len(r)
                if n >= FEW:
                    self._ask(rows, kth, asked, y, first, kinds)
                    kth = np.minimum(kth, self.d[rows, -1])
                    low, asked, n = np.maximum(self._low(rows, kth, y, wide.dtype), low), [], 0
                    low[self._late(rows, first + t)] = np.inf
        self._ask(rows, kth, asked, y, first, kinds)

    def _late(self, rows: np.ndarray, at: int) -> np.ndarray:
        """Of which rows another at distance 0, from position `at` on, would come after those found."""
        return (self.d[rows, -1] == 0) & (self.i[rows, -1] < at)

    def _low(self, rows: np.ndarray, kth: np.ndarray, y: _Side, kind: np.dtype) -> np.ndarray:
        """Below it a product is certain to lie farther than kth."""
        low = (self.q.squares[rows] - kth * kth) / 2 - _margin(y.m.shape[1], self.q.squares[rows], y.most, kind)
        return np.maximum(low, np.finfo(kind).min).astype(kind)

    def _ask(self, rows: np.ndarray, kth: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]], y: _Side, first: int, kinds: np.ndarray) -> None:
        if not asked:
            return
        r, c = (np.concatenate(x) for x in zip(*asked, strict=True))
        other = self.at[rows[r]] != first + c
        r, c = r[other], c[other]
        d = self.distances(rows[r], y, c)
        good = d <= kth[r]
        if good.any():
            self._merge(rows[r[good]], d[good], first + c[good], kinds[c[good]])

    def _merge(self, r, d, i, kind) -> None:
        old = np.unique(r)
        r = np.concatenate([np.repeat(old, self.k), r])
        d, i, kind = (np.concatenate([x[old].ravel(), y]) for x, y in ((self.d, d), (self.i, i), (self.kind, kind)))
        order = np.lexsort((i, d, r))
        r, d, i, kind = r[order], d[order], i[order], kind[order]
        place = np.arange(len(r)) - np.searchsorted(r, old)[np.searchsorted(old, r)]
        top = place < self.k
        for x, y in ((self.d, d), (self.i, i), (self.kind, kind)):
            x[r[top], place[top]] = y[top]

    def kth(self, others: np.ndarray) -> np.ndarray:
        """The k-th, or the last that there is; 0 without others and to or from null."""
        found = np.isfinite(self.d)
        far = np.where(found.any(axis=1), np.where(found, self.d, 0.0).max(axis=1), 0.0)
        far = np.where((self.q.state == 1) & (others > 0) | (far == NAN_AT), np.nan, far)
        return np.where(far == NULL_AT, 0.0, far)


def nearest(df: DataFrame, *, neighbours: int, key: str, embedding: str, label: str | None = None, kind: str | None = None, out: str = "_kth", agree: str = "_agree") -> DataFrame:
    """(key, out, agree): the distance to the min(neighbours, n - 1)-th nearest other row and how many of the nearest (ties by key) are of its kind.

    With a label, other rows are those of the same. Rows alone, without a label or without a vector get 0.
    Every row is compared with all others of its label: the result is cut.
    """
    if neighbours < 1:
        raise ValueError("neighbours must be 1 or more")
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(F.col(key).alias("_k"), _code(F.col(label) if label else None, types.get(label)).alias("_l"), _code(F.col(kind) if kind else None, types.get(kind)).alias("_c"), V.as_double(F.col(embedding)).alias("_e"))
    dealt = rows.repartitionByRange(_parts(rows.count()), "_l", "_k").sortWithinPartitions("_l", "_k")
    longs = [T.StructField(n, T.LongType()) for n in ("chunk", "least", "most", "before")]
    packed = cut(dealt.mapInArrow(_packed, T.StructType([*longs, T.StructField("keys", T.ArrayType(types[key])), *(T.StructField(n, T.BinaryType()) for n in ("labels", "kinds", "state", "vectors"))])))
    asked = packed.select(*(F.col(n).alias(f"_{n}") for n in packed.columns))
    both = _streamed(packed.drop("keys", "before"), asked, (F.col("least") <= F.col("_most")) & (F.col("most") >= F.col("_least")))
    # a task's rows come by label: of those that meet a packed row, the one before the first ends below it
    leads = F.col("_before").isNull() | (F.col("_before") < F.col("least"))
    own = F.when(F.col("chunk") == F.col("_chunk"), F.col("_keys"))
    raw = ("labels", "kinds", "state", "vectors")
    pairs = both.select("_chunk", own.alias("_keys"), *(F.when(F.col("first"), F.col(f"_{n}")).alias(f"_{n}") for n in raw), "chunk", *(F.when(leads, F.col(n)).alias(n) for n in raw))

    def search(batches):
        found: dict[int, tuple] = {}
        keys: dict[int, pa.Array] = {}
        held, y, there, other_kinds = None, None, None, None
        for b in batches:
            for i in range(b.num_rows):
                at, chunk = b.column(0)[i].as_py(), b.column(6)[i].as_py()
                if at not in found:
                    labels, kinds = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in (2, 3))
                    q = _Side(*_of(b.column(4)[i].as_py(), b.column(5)[i].as_py()))
                    found[at] = _Best(q, at * MOST_ROWS, neighbours), labels, kinds, np.full(len(labels), -1)
                best, labels, _, others = found[at]
                if at == chunk:
                    own = b.column(1)[i].values
                    keys[at] = own.take(pa.array(np.arange(len(own))))  # a copy: the batch can go
                if held != chunk:  # copies, as more of its pairs may come in other batches
                    there, other_kinds = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in (7, 8))
                    held, y = chunk, _Side(*_of(b.column(9)[i].as_py(), b.column(10)[i].as_py()))
                other = y.fitted(best.q)
                wide = other.wide(other.precision(best.q))
                runs = np.append(np.flatnonzero(np.diff(labels, prepend=labels[0] - 1)), len(labels))
                a, z = (np.searchsorted(there, labels[runs[:-1]], side) for side in ("left", "right"))
                for run in np.flatnonzero((z > a) & (labels[runs[:-1]] != NO_LABEL)):
                    lo, hi = runs[run], runs[run + 1]
                    others[lo:hi] += z[run] - a[run]
                    for r, end in _even(lo, hi, STRIP):
                        best.see(np.arange(r, end), other, wide, chunk * MOST_ROWS, a[run], z[run], other_kinds)
        for at, (best, _, kinds, others) in found.items():
            same = ((best.kind == kinds[:, None]) & (best.kind != NO_LABEL) & np.isfinite(best.d)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([keys[at], pa.array(best.kth(others)), pa.array(same.astype(np.int64))], names=[key, out, agree])

    schema = T.StructType([T.StructField(key, types[key]), T.StructField(out, T.DoubleType()), T.StructField(agree, T.LongType())])
    with _small_batches(df.sparkSession):
        return cut(pairs.mapInArrow(search, schema))


def greatest_dot(df: DataFrame, bank: DataFrame, *, embedding: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df plus the greatest dot product of its unit vector with the vectors `_r` of bank; null without one."""
    binary = [T.StructField(n, T.BinaryType()) for n in ("state", "vectors")]

    def pack(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                m, state = matrix(whole.column(0).slice(at, block_rows))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (state, m)], names=["state", "vectors"])

    once = cut(bank.where(F.col("_r").isNotNull()).distinct().mapInArrow(pack, T.StructType(binary)))  # copies change no maximum
    nothing = F.lit(b"").alias("state"), F.lit(b"").alias("vectors")
    # a row without vectors: rows of df meet it even if the bank is empty, and travel with it alone
    blocks = once.withColumn("last", F.lit(False)).unionByName(df.sparkSession.range(0, 1, 1, 1).select(*nothing, F.lit(True).alias("last")))
    names = [c for c in df.columns if c != out]

    def ask(batches):
        part, n = TaskContext.get().partitionId() << 24, 0
        for whole in batches:
            for at, end in _even(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(at, end - at)
                m, state = matrix(b.column(b.num_columns - 1))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (kept := b.select(range(b.num_columns - 1))).schema) as stream:
                    stream.write_batch(kept)
                raw = (pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), state.tobytes(), m.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([part + n]), pa.array([n == 0]), *raw], names=["_chunk", "_leads", "_rows", "_state", "_vectors"])
                n += 1

    unit = df.select(*names, V.l2_normalise(V.as_double(F.col(embedding))).alias("_u"))
    asked = unit.repartition(_parts(df.count())).mapInArrow(ask, T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("_leads", T.BooleanType()), *(T.StructField(n, T.BinaryType()) for n in ("_rows", "_state", "_vectors"))]))
    sent = (("last", "_rows"), ("first", "_state"), ("first", "_vectors"), ("_leads", "state"), ("_leads", "vectors"))
    pairs = _streamed(blocks, asked).select("_chunk", *(F.when(F.col(on), F.col(n)).alias(n) for on, n in sent))
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        found: dict[int, tuple] = {}
        rows: dict[int, bytes] = {}
        y = None
        for b in batches:
            for i in range(b.num_rows):
                at = b.column(0)[i].as_py()
                if at not in found:
                    q = _Side(*_of(b.column(2)[i].as_py(), b.column(3)[i].as_py()))
                    found[at] = q, np.full(len(q.m), -np.inf)
                if b.column(1)[i].is_valid:
                    rows[at] = b.column(1)[i].as_py()
                    continue
                if b.column(4)[i].is_valid:
                    y = _Side(*_of(b.column(4)[i].as_py(), b.column(5)[i].as_py()))
                _greatest(*found[at], y)
        for at, (_, best) in found.items():
            kept = pa.ipc.open_stream(rows.pop(at)).read_next_batch()
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best, mask=~np.isfinite(best) & ~np.isnan(best))], names=schema.names)

    return pairs.mapInArrow(run, schema)


def _greatest(q: _Side, best: np.ndarray, y: _Side) -> None:
    """best, with what y adds: stays -inf without a vector or others, NaN if either side is not finite."""
    best[(q.state == 1) | (y.state == 1).any() & (q.state == 0)] = np.nan
    there = np.flatnonzero((q.state == 0) & ~np.isnan(best))
    if not len(there):
        return
    y = y.fitted(q)
    kind = y.precision(q)
    x, t = q.m.astype(kind), y.wide(kind).T[:-1]
    for at, end in _even(0, len(there), STRIP):
        rows = there[at:end]
        for lo, hi in _even(0, len(y.m), TILE):
            g = _product(x[rows], t[:, lo:hi])
            top = g.max(axis=1)
            low = (np.maximum(top, best[rows]) - _margin(y.m.shape[1], q.squares[rows], y.most, kind)).astype(kind)
            hot = np.flatnonzero(top >= low)
            for r, c in _slices(g[hot] >= low[hot, None]):
                r = rows[hot[r]]
                np.maximum.at(best, r, _pairs(q.m, r, y.m, c + lo, False))
