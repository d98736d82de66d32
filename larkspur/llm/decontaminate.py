"""Benchmark decontamination with suffix arrays of the training text.

Every run of training texts inside an Arrow batch is a shard. A shard gets a sparse suffix
array over its words: of all word positions, those stay whose first words open some window
of the benchmark, since no other suffix can share a window. Each distinct benchmark suffix is then
binary-searched in it, which gives the training positions that share its first 13 words. Of
these, matches that can't be carried on to the left are followed to the right for the longest
verbatim match and its place.

Shards are independent, so nothing is shuffled. The benchmark is read to the driver in
blocks of bounded size and each block, about 40 bytes a word, is broadcast; more blocks chain
more passes of the same stage over the running results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import textvec
from larkspur.llm.common import fresh, raw_texts, slices, with_added

WINDOW = 13
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts behind each other and each text's first word (with the total last)."""
    data, offsets = textvec.joined(texts)
    data = data.lower()
    starts, ends = textvec.word_spans(data, textvec.ALNUM)
    return textvec.word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


class Windows:
    """The distinct windows of one length in a block, each with its places and items.

    A window that the benchmark repeats is searched once, however often it stands there.
    """

    def __init__(self, hashes: np.ndarray, at: np.ndarray, item: np.ndarray, begin: np.ndarray, width: int):
        """at, item: place and item of each window; begin: the first place of its item."""
        self.width, self.lead = width, min(width, 3)
        grams = hashes[at[:, None] + np.arange(width)]
        self.before = np.where(at > begin, hashes[np.maximum(at, 1) - 1], np.uint64(0))  # the word on the left; 0 where there is none
        order = np.lexsort((self.before, *grams.T[::-1]))
        grams, self.at, self.item, self.before = grams[order], at[order], item[order], self.before[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]).any(axis=1)
        self.first = np.append(np.flatnonzero(new), len(at))  # places of window i: first[i] to first[i + 1]
        self.key = _lead(grams[new], self.lead)
        self.filter = _Filter(self.key)
        pair = np.unique(np.cumsum(new).astype(np.int64) * (1 << 32) + self.item - (1 << 32))
        self.items, window = (pair & 0xFFFFFFFF).astype(np.int64), pair >> 32
        self.first_item = np.searchsorted(window, np.arange(len(self.first)))

    def grams(self, hashes: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return hashes[self.at[self.first[windows]][:, None] + np.arange(self.width)]


class Block:
    """A part of the benchmark: the hashes of its words and its windows by length."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.hashes, first = _words([t for _, t in items])
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i in range(len(items)):
            n = int(first[i + 1] - first[i])
            if n:
                width = min(window, n)
                by_length.setdefault(width, []).append((i, n - width + 1))
        self.ids = [None if k is None else str(k) for k, _ in items]
        self.end = first[1:]
        self.groups = []
        for width, rows in sorted(by_length.items()):
            at = np.concatenate([np.arange(first[i], first[i] + n) for i, n in rows])
            item = np.concatenate([np.full(n, i) for i, n in rows])
            self.groups.append(Windows(self.hashes, at, item, first[item], width))


def _lead(grams: np.ndarray, lead: int) -> np.ndarray:
    out = grams[:, 0].copy()
    for j in range(1, lead):
        out = out * np.uint64(0x9E3779B97F4A7C15) + grams[:, j]
    return out


def _leads(hashes: np.ndarray, lead: int, n: int) -> np.ndarray:
    out = hashes[:n].copy()
    for j in range(1, lead):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : n + j]
    return out


class _Filter:
    """Membership of 64-bit keys: a bit table first, then binary search among the survivors."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = np.uint64(64 - max(16, min(26, int(len(self.keys)).bit_length() + 5)))
        self.hit = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.hit[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def positions(self, keys: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.hit[self._slot(keys)])
        found = np.searchsorted(self.keys, keys[at])
        found[found == len(self.keys)] = 0
        return at[self.keys[found] == keys[at]]


def _bound(shard: np.ndarray, tests: np.ndarray, after: bool) -> np.ndarray:
    """For each test suffix, how many shard suffixes sort before it (or not after it)."""
    low, high = np.zeros(len(tests), dtype=np.int64), np.full(len(tests), len(shard), dtype=np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        a, b = shard[mid], tests[open_]
        differ = a != b
        column = differ.argmax(axis=1)
        rows = np.arange(len(open_))
        less = a[rows, column] < b[rows, column]
        if after:
            less |= ~differ.any(axis=1)
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


def matches(hashes: np.ndarray, first: np.ndarray, block: Block) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
    """(windows, training positions, window at each) of every window of the block in a shard, by position."""
    owner_end = first[1:]
    for group in block.groups:
        n = len(hashes) - group.width + 1
        if n <= 0:
            continue
        leads = _leads(hashes, group.lead, n)
        suffixes = group.filter.positions(leads)
        document = np.searchsorted(owner_end, suffixes, side="right")
        suffixes = suffixes[suffixes + group.width <= owner_end[document]]
        if not len(suffixes):
            continue
        live = np.flatnonzero(np.isin(group.key, leads[suffixes]))
        shard = hashes[suffixes[:, None] + np.arange(group.width)]
        order = np.lexsort(shard.T[::-1])  # the shard's suffix array
        suffixes, shard = suffixes[order], shard[order]
        tests = group.grams(block.hashes, live)
        low, high = _bound(shard, tests, False), _bound(shard, tests, True)
        count = high - low  # windows are distinct: no suffix is found twice
        if not count.sum():
            continue
        window = np.repeat(live, count)
        place = suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        by_place = np.argsort(place)
        yield group, place[by_place], window[by_place]


def _starts(hashes: np.ndarray, first: np.ndarray, position: np.ndarray, window: np.ndarray, group: Windows, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(training position, benchmark place) of every match of a window that can't be carried on to the left, `most` or so at a time."""
    left = np.where(np.isin(position, first), np.uint64(0), hashes[np.maximum(position, 1) - 1])
    begin, end = group.first[window], group.first[window + 1]
    # a window's places are sorted by the word before them: those with the same word as here are one run, which is left out
    same, rest = np.empty_like(begin), np.empty_like(end)
    for bound, after in ((same, False), (rest, True)):
        lo, hi = begin.copy(), end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = group.before[mid] <= left[open_] if after else group.before[mid] < left[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        bound[:] = lo
    none = left == 0
    rest[none] = same[none]  # at the start of a text every place is a start
    lo, count, p = np.concatenate([begin, rest]), np.concatenate([same - begin, end - rest]), np.concatenate([position, position])
    keep = np.flatnonzero(count)
    lo, count, p = lo[keep], count[keep], p[keep]
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + most, side="right")))
        c = count[a:b]
        yield np.repeat(p[a:b], c), group.at[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[a:b], c)]
        a = b


def _longest(hashes: np.ndarray, first: np.ndarray, block: Block, position: np.ndarray, window: np.ndarray, group: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For each row of first but the last, the words of its longest verbatim match and the word at which the first of these begins."""
    best, place = np.zeros(len(first) - 1, dtype=np.int64), np.full(len(first) - 1, -1, dtype=np.int64)
    for p, b in _starts(hashes, first, position, window, group):
        row = np.searchsorted(first[1:], p, side="right")
        most = np.minimum(first[1:][row] - p, block.end[np.searchsorted(block.end, b, side="right")] - b)
        n = np.full(len(p), group.width, dtype=np.int64)
        open_ = np.flatnonzero(n < most)
        while len(open_):
            same = hashes[p[open_] + n[open_]] == block.hashes[b[open_] + n[open_]]
            open_ = open_[same]
            n[open_] += 1
            open_ = open_[n[open_] < most[open_]]
        order = np.lexsort((p, -n, row))
        head = order[np.append(True, row[order][1:] != row[order][:-1])]
        better = (n[head] > best[row[head]]) | ((n[head] == best[row[head]]) & (p[head] - first[row[head]] < place[row[head]]))
        head = head[better]
        best[row[head]], place[row[head]] = n[head], p[head] - first[row[head]]
    return best, place


_SPANS = pa.list_(pa.int64())


def _search(column: pa.Array, known: pa.Array | None, block: Block) -> tuple[list, ...]:
    """n_words, hit word ranges, items, longest match and its place, for each row."""
    texts = raw_texts(column)
    before = known.to_pylist() if known is not None else [None] * len(texts)
    n_words = np.zeros(len(texts), dtype=np.int64)
    ranges: list[list[int]] = []
    items: list[list[str]] = []
    longest, place = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), -1, dtype=np.int64)
    for begin, end in slices(texts):
        hashes, first = _words(texts[begin:end])
        n_words[begin:end] = np.diff(first)
        edges = np.zeros(len(hashes) + 1, dtype=np.int32)
        found: dict[int, set[str]] = {}
        for group, position, window in matches(hashes, first, block):
            np.add.at(edges, position, 1)
            np.add.at(edges, position + group.width, -1)
            document = np.searchsorted(first[1:], position, side="right")
            for pair in np.unique(document * (1 << 32) + window).tolist():
                w = pair & 0xFFFFFFFF
                names = (block.ids[i] for i in group.items[group.first_item[w] : group.first_item[w + 1]])
                found.setdefault(pair >> 32, set()).update(x for x in names if x is not None)
            n, at = _longest(hashes, first, block, position, window, group)
            better = np.flatnonzero(n > longest[begin:end])
            longest[begin + better], place[begin + better] = n[better], at[better]
        hit = np.cumsum(edges[:-1]) > 0
        for k in range(begin, end):
            mine = hit[first[k - begin] : first[k - begin + 1]]
            old = before[k]
            if old and old["ranges"]:
                mine = mine.copy()
                for a, b in zip(old["ranges"][0::2], old["ranges"][1::2], strict=True):
                    mine[a:b] = True
            if mine.any():
                change = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                ranges.append(change.tolist())
            else:
                ranges.append([])
            names = found.get(k - begin, set()) | set((old or {}).get("items") or ())
            items.append(sorted(names))
            if old and old["longest"] > longest[k]:
                longest[k], place[k] = old["longest"], old["place"]
    return n_words, ranges, items, longest, place


_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("place", T.LongType()),
    ]
)


def _pass(df: DataFrame, text_col: str, state: str, block, seen: bool) -> DataFrame:
    """One block of the benchmark against all texts; the state column takes the block's hits in."""
    if not seen:
        return with_added(df, [T.StructField(state, _STATE)], text_col, lambda c: [_packed(_search(c, None, block.value))])
    at, known, schema = df.columns.index(text_col), df.columns.index(state), df.schema

    def run(batches):
        for b in batches:
            arrays = list(b.columns)
            arrays[known] = _packed(_search(b.column(at), b.column(known), block.value))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def _packed(found) -> pa.Array:
    n_words, ranges, items, longest, place = found
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(ranges, type=_SPANS), pa.array(items, type=pa.list_(pa.string())), pa.array(longest), pa.array(place)],
        names=["n_words", "ranges", "items", "longest", "place"],
    )


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of at most block_bytes of text (a longer item is a block of its own)."""
    held, total = [], 0
    for row in benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("binary")).toLocalIterator():
        text = None if row[1] is None else bytes(row[1])
        if held and total + len(text or b"") > block_bytes:
            yield Block(held, window)
            held, total = [], 0
        held.append((row[0], text))
        total += len(text or b"")
    yield Block(held, window)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, state_col: str = "contamination"
) -> tuple[DataFrame, str]:
    """docs plus one struct column (its name is returned too) with what the benchmark shares with each text.

    n_words; ranges: flat [start, end) pairs of hit words; items: ids of items with an occurring
    window, sorted as strings; longest and place: words and first word of the longest verbatim match.
    Null texts have no words; items without words match nothing; items with a null id hit words but
    are not listed; repeated items and repeated documents count like any other row. An empty
    benchmark hits nothing.
    """
    state = fresh(docs.columns, state_col)
    sc = docs.sparkSession.sparkContext
    out, seen = docs, False
    for block in blocks(benchmark, item_id_col, item_text_col, window, block_bytes):
        out, seen = _pass(out, text_col, state, sc.broadcast(block), seen), True
    return out, state


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest match and its first word."""
    found, s = find_contamination(docs.select(id_col, kw.get("text_col", "text")), benchmark, **kw)
    n_hit = F.expr(f"aggregate(`{s}`.ranges, 0L, (a, x) -> x - a)")  # ends minus starts: alternating sum
    return found.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{s}`.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"`{s}`.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"`{s}`.items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col(f"`{s}`.n_words"))).alias("contaminated"),
        F.col(f"`{s}`.longest").alias("longest_match"),
        F.col(f"`{s}`.place").alias("longest_at"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs whose hit words are fewer than a twentieth of their words."""
    found, s = find_contamination(docs, benchmark, **kw)
    n_hit = F.expr(f"aggregate(`{s}`.ranges, 0L, (a, x) -> x - a)")
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(f"`{s}`.n_words")))).drop(s)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
