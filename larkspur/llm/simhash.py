"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r/2 of both. Emitting every variant
within 2 of all 64 bits costs 2081 records a fingerprint, so the ball hashing runs on halves
first: at most 4 differing bits leave at most 2 in one 32-bit half, so a fingerprint emits,
for each half, the 33 variants within 1 bit, and linked pairs share a (half, variant) key.
One shuffle on that key brings collisions together; runs of a key with few fingerprints are
verified pair by pair. A crowded key is not expanded into pairs: its fingerprints (once
each) emit the whole 64-bit ball of 2081 variants. All fingerprints that share such a
variant lie within 4 bits of each other, so they are linked to their least member as a star;
and no variant has more than 2081 distinct fingerprints, so no key can grow without bound.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import fresh, raw_texts, spread_join, staged, with_added
from larkspur.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints under one half variant that are compared pair by pair; beyond it the 64-bit ball is used.
CROWD = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    clean = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    begins = [0, *ends[:-1]]
    k = min(shingle, len(words))
    one = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((one(clean[a : b - 1], SEED) for a, b in zip(begins, ends[k - 1 :], strict=False)), dtype=np.uint64, count=n)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", fp_col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs plus the fingerprint as a signed 64-bit column."""

    def run(column: pa.Array) -> list[pa.Array]:
        prints = np.array([fingerprint(t, shingle) for t in raw_texts(column)], dtype=np.uint64)
        return [pa.array(prints.view(np.int64))]

    return with_added(docs, [T.StructField(fp_col, T.LongType())], text_col, run)


def _half_variants(prints: DataFrame) -> DataFrame:
    """(half, key, fp): each 32-bit half of fp with no bit or one bit flipped."""
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("1L") * F.pow(F.lit(2.0), i).cast("long")))
    masks = prints.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("half"), F.expr("shiftrightunsigned(fp, 32)").alias("value")),
                F.struct(F.lit(1).alias("half"), F.expr("fp & 4294967295L").alias("value")),
            )
        ).alias("h"),
    )
    return masks.select("fp", "h.half", "h.value", F.explode(flips).alias("flip")).select("half", F.col("value").bitwiseXOR(F.col("flip")).alias("key"), "fp")


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _halves(fp: np.ndarray, half: np.ndarray) -> np.ndarray:
    return np.where(half == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))


def _verify(half: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted (half, key, fp) rows of whole runs; crowded runs give (fp, fp) instead."""
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (half[1:] != half[:-1]) | (key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(fp)))
    size = np.repeat(length, length)
    crowded = size > crowd
    a, b = [fp[crowded]], [fp[crowded]]
    left = np.flatnonzero((size > 1) & ~crowded)
    rank = np.arange(len(fp)) - np.repeat(begin, length)
    for step in range(1, crowd):
        left = left[rank[left] + step < size[left]]
        if not len(left):
            break
        x, y, h = fp[left], fp[left + step], half[left]
        differ = x ^ y
        part = _halves(differ, h)
        within = np.bitwise_count(part)
        low = part & (~part + np.uint64(1))  # the lowest differing bit
        p, q = _halves(x, h), _halves(y, h)
        first = np.where(within == 2, np.minimum(p ^ low, p ^ part ^ low), np.minimum(p, q))
        ok = (np.bitwise_count(differ) <= radius) & (first == key[left])
        ok &= (h == 0) | (np.bitwise_count(differ >> np.uint64(32)) > 2)  # else found in the first half
        a.append(x[ok])
        b.append(y[ok])
    return np.concatenate(a), np.concatenate(b)


def _collide(batches: Iterator[pa.RecordBatch], radius: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (half, key, fp); holds at most the last run, and of that `crowd` + 1 rows."""
    tail = [np.empty(0, dtype=np.int64)] * 3
    names = ["a", "b"]

    def emit(rows):
        half, key, fp = rows
        x, y = _verify(half, key.view(np.uint64), fp.view(np.uint64), radius, crowd)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=names)

    spilled = None  # the crowded run that is being passed on, by (half, key)
    for batch in batches:
        rows = [np.concatenate([t, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for t, c in zip(tail, batch.columns, strict=True)]
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = len(same) if not same.any() else int(np.argmax(same))
        if spilled is not None:
            mine = (rows[0] == spilled[0]) & (rows[1] == spilled[1])
            if mine.any():
                fp = rows[2][mine]
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp)], names=names)
                rows = [r[~mine] for r in rows]
                cut = max(0, cut - int(mine.sum())) if not mine[-1] else len(rows[0])
            if not len(rows[0]):
                tail = [np.empty(0, dtype=np.int64)] * 3
                continue
            spilled = None
        if cut:
            yield emit([r[:cut] for r in rows])
        tail = [r[cut:] for r in rows]
        if len(tail[0]) > crowd:
            spilled = (int(tail[0][0]), int(tail[1][0]))
            yield pa.RecordBatch.from_arrays([pa.array(tail[2]), pa.array(tail[2])], names=names)
            tail = [np.empty(0, dtype=np.int64)] * 3
    if len(tail[0]):
        yield emit(tail)


def ball(radius: int, bits: int = 64) -> list[int]:
    """Every mask with at most `radius` of `bits` bits set, as signed 64-bit numbers."""
    masks = [sum(1 << i for i in c) for n in range(radius + 1) for c in itertools.combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): each distinct fp linked to the least fp that shares a 64-bit variant within radius / 2 (even radius)."""
    if radius % 2:
        raise ValueError("the whole ball needs an even radius")
    masks = F.array(*(F.lit(m).cast("long") for m in ball(1)))
    variants = prints.select("fp", F.explode(masks).alias("m1")).select("fp", F.col("fp").bitwiseXOR(F.col("m1")).alias("v1"))
    for _ in range(radius // 2 - 1):
        variants = variants.select("fp", F.explode(masks).alias("m"), "v1").select("fp", F.col("v1").bitwiseXOR(F.col("m")).alias("v1")).distinct()
    least = variants.groupBy("v1").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("v1", "b")
    return variants.join(least, "v1").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(prints: DataFrame, *, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(u, v) links that connect exactly the distinct fingerprints (column fp) joined by chains of distances <= radius.

    Radii up to 4 take the halves; pairs of uncrowded keys come out verified, once each.
    """
    if not 0 < radius <= 4:
        raise ValueError("the halves cover radii from 1 to 4")
    spark = prints.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = _half_variants(prints).repartition(n, "half", "key").sortWithinPartitions("half", "key", "fp")
    pairs = staged(dealt.mapInArrow(lambda it: _collide(it, radius, crowd), _PAIRS), "pairs")
    crowded = pairs.where("a = b").select(F.col("a").alias("fp")).distinct()
    # an odd radius would need verification after the even ball; crowded members then compare by ball of radius - 1 and half runs
    wide = ball_links(crowded, radius) if radius % 2 == 0 else _odd_links(crowded, radius)
    return pairs.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(wide.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _odd_links(prints: DataFrame, radius: int) -> DataFrame:
    """For odd radii: variants within radius // 2 on one side and one more on the other, by an equi-join."""
    near, far = ball(radius // 2), ball(radius // 2 + 1)
    own = prints.select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in near))).alias("m")).select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    other = prints.select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in far))).alias("m")).select(F.col("fp").alias("b"), F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    least = own.groupBy("v").agg(F.min("a").alias("a"))
    return other.join(least, "v").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, crowd: int = CROWD, keep_columns: bool = False) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least id reachable over links).

    Texts are lower-cased (A-Z), split at ASCII white space and shingled by `shingle` words; texts of
    fewer words are one shingle, texts without words (null, empty) have fingerprint zero. Repeated
    rows fall in one component; null ids get the least non-null id of their component, or null.
    An empty table gives an empty result. With keep_columns, the columns of docs (whatever their
    names) and one row of each component: that with the least id, nulls last, ties by row number.
    """
    fp, row = fresh(docs.columns, "fingerprint"), fresh(docs.columns, "row_number")
    base = docs if keep_columns else docs.select(id_col, text_col)
    marked = with_fingerprint(base, text_col=text_col, fp_col=fp, shingle=shingle)
    table = staged(marked.withColumn(row, F.monotonically_increasing_id()) if keep_columns else marked.select(F.col(f"`{id_col}`").alias("doc_id"), fp), "prints")
    one = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(row)) if keep_columns else F.col("doc_id")
    prints = staged(table.groupBy(F.col(fp).alias("fp")).agg(F.min(one).alias("least"), F.count("*").alias("rows")), "distinct")
    parts = connected_components(links(prints.select("fp"), radius=radius, crowd=crowd))
    classed = staged(prints.join(parts, prints.fp == parts.node, "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("component")), "classes")
    roots = classed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    if keep_columns:
        kept = roots.select(F.col(f"component_id.{row}").alias(row))
        return table.join(kept, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))
    # a component of near copies, and a fingerprint of exact ones (or of texts without words), may hold any share of the rows
    named = spread_join(classed, staged(roots, "roots"), "component", "members")
    named = staged(named.select(F.col("fp").alias(fp), "component_id", "rows"), "named")
    full = spread_join(table, named, fp, "rows")
    return full.select("doc_id", F.lower(F.lpad(F.hex(F.col(fp)), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """docs with one row of each near-duplicate component: the least id's (nulls last)."""
    return near_duplicates(docs, keep_columns=True, **kw)
