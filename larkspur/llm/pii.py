"""Personal data: fixed patterns, and bootstrapped contextual extraction beyond them.

Seeds are the spans of the fixed patterns and tokens that look like secrets. What stands
around every candidate token induces lexical patterns: the cue word and the separator before
it, the capital prefix and length of the token itself, or the one to three words left or right
of a seed. Patterns and instances form a bipartite graph that Spark scores in turn: a pattern
by the mean value of its distinct instances, an instance by its seed value or its best accepted
pattern, until no more patterns reach the confidence. Tokens found by accepted patterns are
spans even where no seed covers them.

Word contexts are found in passes: the contexts of seeds with their counts of distinct seeds,
then the distinct other tokens in the same contexts, of which a task sends no more than decide
against the context. Only contexts with a share of seeds enter the graph, and now and then one
that shares their slot in the table that tasks look them up in; the graph's exact counts decide.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import fresh, shared_dir, spread_join, staged, with_added

# Kinds in order, and what their patterns match.
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = str.maketrans("", "", " -().+")
#: A cue: a word, a separator with = or :, an optional quote, then the candidate.
_CUE = re.compile(r"(?<![^\W_])([^\W\d_]{2,}+)(\x20?[=:]{1,2}\x20?[\"']?)([^\s\"',;<>]{4,})")
#: A candidate by its own shape: capitals and digits.
_SHAPE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[A-Z0-9]{10,}+(?![A-Za-z0-9])")
#: Confidence of accepted patterns, distinct instances they need.
CONFIDENCE, SUPPORT = 0.7, 3
#: Words of a context on one side, the least share of its distinct tokens that are seeds, and the least length of a token that it adds.
WORDS, SHARE, LEAST = 3, 0.5, 4
#: Slots of the table in which tasks look contexts up; a power of two.
SLOTS = 1 << 22
#: What stands before the second word of contexts in that table; no context begins so.
SECOND = {"left": "left2", "right": "right2"}
#: What does not count at either end of a word.
_EDGE = ".,;:!?()[]{}<>\"'`|*=-"
_CHUNK = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start; code points, end exclusive."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(m[0].translate(_NOT_DIGITS)) <= 15:
            out.append(("phone", *m.span()))
    return out


def secret_like(token: str) -> bool:
    """Whether a token is long and mixes digits with letters as random keys do."""
    if len(token) < 16:
        return False
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    return digits >= 4 and letters >= 2 and digits + letters >= 0.9 * len(token)


def occurrences(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, pattern, instance, seed) of every candidate token next to a cue or of a key's shape."""
    if not text:
        return []
    out = []
    covered = [(a, b) for _, a, b in base]
    if "=" in text or ":" in text:
        for m in _CUE.finditer(text):
            a, b = m.span(3)
            while b > a and text[b - 1] in ".)]}":
                b -= 1
            token = text[a:b]
            if len(token) >= 4:
                seed = secret_like(token) or any(x < b and a < y for x, y in covered)
                out.append((a, b, f"cue {m[1].lower()}{m[2].strip(chr(32) + chr(34) + chr(39))}", token, seed))
    for m in _SHAPE.finditer(text):
        token = m[0]
        if any("0" <= c <= "9" for c in token):
            out.append((*m.span(), f"shape {token[:4]} {len(token)}", token, secret_like(token)))
    return out


def words(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends; what is punctuation only is no word."""
    return [v for w in text.lower().split() if (v := w.strip(_EDGE))]


def word_spans(text: str) -> list[tuple[int, int]]:
    """The chunk between white space of each of words(text)."""
    return [m.span() for m in _CHUNK.finditer(text) if m[0].strip(_EDGE)]


def seed_spans(base: list[tuple[str, int, int]], occ: list[tuple[int, int, str, str, bool]]) -> list[tuple[int, int]]:
    return sorted({(a, b) for _, a, b in base} | {(a, b) for a, b, _, _, seed in occ if seed})


def seed_contexts(text: str, seeds: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """(pattern, instance): the one to three words left and right of every seed span."""
    if not seeds:
        return []
    ws, spans = words(text), word_spans(text)
    starts = [a for a, _ in spans]
    out = []
    for a, b in seeds:
        i, j = bisect_right(starts, a) - 1, bisect_left(starts, b)
        out += [(f"left {' '.join(ws[i - n : i])}", text[a:b]) for n in range(1, min(WORDS, i) + 1)]
        out += [(f"right {' '.join(ws[j : j + n])}", text[a:b]) for n in range(1, min(WORDS, len(ws) - j) + 1)]
    return out


class _Kept(dict):
    """Values of fn, kept."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        self[key] = value = self.fn(key)
        return value


class Contexts:
    """Word contexts to look for, as a table of fixed size, however many there are.

    A slot has the greatest worth of the contexts whose hash falls there, 0 for none. A context of several
    words is looked for only where the nearer words alone have a worth, and so have the nearest and the
    second word on their own; those above `least` are hits.
    What shares a slot with another context may be a hit too, so exact counts must follow.
    """

    def __init__(self, worth: array, least: int = 0):
        self.worth, self.least, self.mask = worth, least, len(worth) - 1
        self.dropped: set[str] = set()
        self.near = _Kept(self._near)
        self.second = {side: _Kept(lambda w, start=start: self(f"{start} {w}")) for side, start in SECOND.items()}
        self.two = {side: _Kept(lambda ws, side=side: (self(p := f"{side} {ws[0]} {ws[1]}"), p)) for side in SECOND}

    def __call__(self, pattern: str) -> int:
        return self.worth[xxhash.xxh64_intdigest(pattern.encode(), 42) & self.mask]

    def _near(self, w: str) -> tuple:
        """Worths and patterns of the contexts that are this word alone; () if it is the nearest word of none."""
        if not self(w):
            return ()
        p, q = "left " + w, "right " + w
        left, right = self(p), self(q)
        return (left, right, p, q) if left or right else ()

    def drop(self, pattern: str) -> None:
        self.dropped.add(pattern)

    def hits(self, ws: list[str]) -> list[tuple[int, str]]:
        """(word, pattern) of every word in a context."""
        for kept in (self.near, *self.second.values(), *self.two.values()):
            if len(kept) > 1 << 19:
                kept.clear()
        (before, after), (left_two, right_two) = self.second.values(), self.two.values()
        out, last, least, dropped = [], len(ws) - 1, self.least, self.dropped
        for i, worth in enumerate(map(self.near.__getitem__, ws)):
            if not worth:
                continue
            left, right, p, q = worth
            if left and i < last:
                if left > least and p not in dropped:
                    out.append((i + 1, p))
                if i and before[ws[i - 1]]:
                    value, p = left_two[ws[i - 1], ws[i]]
                    if value:
                        self._longer(out, i + 1, value, p, ("left " + " ".join(ws[i - n + 1 : i + 1]) for n in range(3, min(WORDS, i + 1) + 1)))
            if right and i:
                if right > least and q not in dropped:
                    out.append((i - 1, q))
                if i < last and after[ws[i + 1]]:
                    value, q = right_two[ws[i], ws[i + 1]]
                    if value:
                        self._longer(out, i - 1, value, q, ("right " + " ".join(ws[i : i + n]) for n in range(3, min(WORDS, last - i + 1) + 1)))
        return out

    def _longer(self, out: list[tuple[int, str]], to: int, value: int, p: str, more: Iterator[str]) -> None:
        while value:
            if value > self.least and p not in self.dropped:
                out.append((to, p))
            if (p := next(more, "")) == "":
                return
            value = self(p)


def _table(contexts: DataFrame, worth: Column, slots: int = SLOTS) -> array:
    """The table of Contexts from (pattern, ..), combined before it reaches the driver: at most `slots` numbers."""
    side = F.element_at("w", 1)
    inner = F.when(side == "left", F.slice("w", F.size("w"), 1)).otherwise(F.slice("w", F.lit(2), F.lit(1)))
    middle = F.when(F.size("w") < 4, F.slice("w", F.lit(2), F.size("w") - 1)).when(side == "left", F.slice("w", F.lit(3), F.lit(2))).otherwise(F.slice("w", F.lit(2), F.lit(2)))
    rows = contexts.select(F.split("pattern", " ").alias("w"), "pattern", worth.cast("long").alias("worth"))
    nearest = F.when(side == "left", F.element_at("w", -1)).otherwise(F.get("w", F.lit(1)))
    second = F.when(F.size("w") > 2, F.when(side == "left", F.concat(F.lit(f"{SECOND['left']} "), F.get("w", F.size("w") - 2))).otherwise(F.concat(F.lit(f"{SECOND['right']} "), F.get("w", F.lit(2)))))
    # the nearer words of a context lead to it, and so do its nearest word and its second, each on its own
    stems = F.array(F.struct("pattern", "worth"), *(F.struct(F.concat_ws(" ", side, x).alias("pattern"), F.lit(1).cast("long").alias("worth")) for x in (inner, middle)), *(F.struct(x.alias("pattern"), F.lit(1).cast("long").alias("worth")) for x in (second, nearest)))
    slot = F.xxhash64("s.pattern").bitwiseAND(F.lit(slots - 1).cast("long"))
    got = rows.select(F.explode(stems).alias("s")).where("s.pattern IS NOT NULL").groupBy(slot.alias("slot")).agg(F.least(F.max("s.worth"), F.lit((1 << 32) - 1)).alias("worth")).toArrow()
    if not len(got):
        return array("I")
    out = np.zeros(slots, dtype=np.uint32)
    out[got["slot"].to_numpy()] = got["worth"].to_numpy()
    return array("I", out.tobytes())


def in_contexts(text: str | None, contexts: Contexts, base: list[tuple[str, int, int]] | None = None, occ: list[tuple[int, int, str, str, bool]] | None = None, hits: list[tuple[int, str]] | None = None) -> list[tuple[int, int, str, str, bool]]:
    """Occurrences, as of `occurrences`, of what stands in the contexts: the span of a fixed pattern, a candidate token or else a word."""
    if not (contexts.worth and text):
        return []
    hits = contexts.hits(words(text)) if hits is None else hits
    if not hits:
        return []
    base = base_spans(text) if base is None else base
    occ = occurrences(text, base) if occ is None else occ
    seeds = set(seed_spans(base, occ))
    spans = word_spans(text)
    starts = [a for a, _ in spans]
    firsts: dict[int, tuple[int, int]] = {}
    lasts: dict[int, tuple[int, int]] = {}
    inside = set()
    # seeds come before other candidates, so that these do not stand for a chunk that has a seed
    for a, b in [*sorted(seeds), *sorted({(a, b) for a, b, *_ in occ} - seeds)]:
        i, j = bisect_right(starts, a) - 1, bisect_left(starts, b) - 1
        inside.update(range(i, j + 1))
        if (a, b) in seeds:
            firsts.setdefault(i, (a, b))
            lasts[j] = (a, b)
        else:
            firsts.setdefault(i, (a, b))
            lasts.setdefault(j, (a, b))
    out = []
    for i, p in hits:
        got = (firsts if p.startswith("left") else lasts).get(i)
        if got is None:
            if i in inside:  # amid a span of several words
                continue
            a, b = spans[i]
            chunk = text[a:b]
            a += len(chunk) - len(chunk.lstrip(_EDGE))
            got = a, a + len(chunk.strip(_EDGE))
        token = text[got[0] : got[1]]
        out.append((*got, p, token, got in seeds or secret_like(token)))
    return out


def unseeded(text: str, contexts: Contexts) -> list[tuple[str, str]]:
    """(pattern, token) of what stands in the contexts and is no seed."""
    hits = contexts.hits(words(text)) if contexts.worth else []
    if not hits:
        return []
    base = base_spans(text)
    occ = occurrences(text, base)
    if base or occ:
        return [(p, token) for _, _, p, token, seed in in_contexts(text, contexts, base, occ, hits) if not seed]
    tokens = [v for w in text.split() if (v := w.strip(_EDGE))]  # as many as words: nothing spans several of them
    return [(p, tokens[i]) for i, p in hits if not secret_like(tokens[i])]


_OCC = T.StructType([T.StructField(n, t) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("pattern", T.StringType()), ("instance", T.StringType()), ("seed", T.BooleanType()))])
_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_OCC_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(names: tuple[str, ...], found: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    return pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in found], type=kind)


_PAIR = pa.schema([("pattern", pa.string()), ("instance", pa.string())])


def _pairs(docs: DataFrame, text_col: str, of) -> DataFrame:
    """(pattern, instance) rows that of makes from the texts of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str | None]] = []
        for row in of(t for b in batches for t in b.column(0).to_pylist() if t):
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in zip(*rows, strict=True)], schema=_PAIR)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in zip(*rows, strict=True)], schema=_PAIR)

    return docs.select(f"`{text_col}`").mapInArrow(run, "pattern string, instance string")


def word_contexts(docs: DataFrame, *, text_col: str, support: int = SUPPORT, share: float = SHARE, slots: int = SLOTS) -> DataFrame:
    """(pattern): contexts of at least `support` distinct seeds that make up at least `share` of the distinct tokens there.

    A task stops counting the other tokens of a context once they are too many for the share, and
    sends one row for it. So common contexts stay small, and none that has the share is lost.
    """

    def seeded(texts: Iterator[str]) -> Iterator[tuple[str, str]]:
        for t in texts:
            base = base_spans(t)
            yield from seed_contexts(t, seed_spans(base, occurrences(t, base)))

    found = _pairs(docs, text_col, seeded).groupBy("pattern", "instance").agg(F.lit(1).alias("one"))
    counts = staged(found.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "seeded")
    most = (1 - share) / share
    shared = docs.sparkSession.sparkContext.broadcast(_table(counts, F.col("n"), slots))

    def others(texts: Iterator[str]) -> Iterator[tuple[str, str | None]]:
        contexts = Contexts(shared.value)
        seen: dict[str, set[str]] = {}
        for t in texts:
            for p, token in unseeded(t, contexts):
                if p in contexts.dropped:
                    continue
                of = seen.setdefault(p, set())
                of.add(token)
                if len(of) > contexts(p) * most:
                    del seen[p]
                    contexts.drop(p)
                    yield p, None
        for p, of in seen.items():
            for token in of:
                yield p, token

    pairs = _pairs(docs, text_col, others).groupBy("pattern", "instance").agg(F.lit(1).alias("one"))
    rest = pairs.groupBy("pattern").agg(F.count("*").alias("others"), F.max(F.col("instance").isNull()).alias("over"))
    judged = counts.join(rest, "pattern", "left")
    return staged(judged.where(~F.coalesce("over", F.lit(False)) & (F.coalesce("others", F.lit(0)) <= F.col("n") * most)).select("pattern"), "contexts")


def scanned(docs: DataFrame, *, text_col: str, keep: list[str], base_col: str, occ_col: str, row_col: str, contexts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The keep columns, base spans, occurrences and a row number, as a staged table."""
    shared = docs.sparkSession.sparkContext.broadcast(_table(contexts, F.lit(2), slots))
    held: list[Contexts] = []

    def run(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        base = [base_spans(t) for t in texts]
        occ = [occurrences(t, b) for t, b in zip(texts, base, strict=True)]
        if not held:
            held.append(Contexts(shared.value, 1))
        occ = [[*o, *in_contexts(t, held[0], b, o)] for t, b, o in zip(texts, base, occ, strict=True)]
        return [_rows(("kind", "start", "end"), base, _SPAN_ARROW), _rows(("start", "end", "pattern", "instance", "seed"), occ, _OCC_ARROW)]

    columns = list(dict.fromkeys([*keep, text_col]))
    marked = with_added(docs.select(*(f"`{c}`" for c in columns)), [T.StructField(base_col, T.ArrayType(_SPAN)), T.StructField(occ_col, T.ArrayType(_OCC))], text_col, run)
    return staged(marked.select(*(f"`{c}`" for c in keep), base_col, occ_col, F.monotonically_increasing_id().alias(row_col)), "pii")


def confident_patterns(occ: DataFrame, *, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, score) of accepted patterns from occurrences (pattern, instance, seed).

    One row stands for each distinct (pattern, instance), so copies of a text add nothing. A
    pattern's score is the sum of its instances' values over their number plus one half; an
    instance's value is 1 for a seed and else the best score of an accepted pattern that has it. Rounds
    go on while patterns are accepted: values only grow, so it ends.
    """
    graph = staged(occ.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")), "graph")
    degrees = staged(graph.groupBy("instance").agg(F.count("*").alias("rows")), "instances")
    total, accepted = degrees.agg(F.sum("rows")).first()[0] or 0, 0
    now = graph.withColumn("value", F.col("seed"))
    while True:
        scores = now.groupBy("pattern").agg((F.sum("value") / (F.count("*") + 0.5)).alias("score"), F.count("*").alias("rows"))
        good = staged(scores.where((F.col("score") >= confidence) & (F.col("rows") >= support)), "patterns")
        if (n := good.count()) == accepted:
            return good.select("pattern", "score")
        accepted = n
        best = spread_join(graph.select("pattern", "instance"), good, "pattern", "rows", total=total).groupBy("instance").agg(F.max("score").alias("best"))
        known = staged(best.join(degrees, "instance"), "known")
        now = spread_join(graph, known, "instance", "rows", total=total, how="left").withColumn("value", F.greatest("seed", F.coalesce("best", F.lit(0.0))))


def find_personal(docs: DataFrame, *, text_col: str = "text", keep: list[str], **kw) -> tuple[DataFrame, str, str]:
    """The keep columns of each row, whatever their names, plus base spans and all spans (names are returned too).

    Spans are structs of kind, start, end in code points; added ones have kind `context`, do not
    overlap base spans or one another, and come last. Null and empty texts have none. Repeated
    rows get equal spans; an empty table gives an empty result.
    """
    shared_dir(docs.sparkSession)
    base, occ, row = (fresh([*docs.columns], n) for n in ("base_spans", "occurrences", "row_number"))
    contexts = word_contexts(docs, text_col=text_col, support=kw.get("support", SUPPORT))
    table = scanned(docs, text_col=text_col, keep=keep, base_col=base, occ_col=occ, row_col=row, contexts=contexts)
    flat = table.where(F.size(occ) > 0).select(F.col(row).alias("row"), F.col(base).alias("base"), F.explode(occ).alias("o")).select("row", "base", "o.*")
    good = confident_patterns(flat.select("pattern", "instance", "seed"), **kw)
    counted = staged(flat.groupBy("pattern").agg(F.count("*").alias("rows")).join(good, "pattern").select("pattern", "rows"), "accepted")
    found = spread_join(flat, counted, "pattern", "rows").where(F.col("end") - F.col("start") >= LEAST)
    found = found.where(~F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    of_row, more = fresh([*docs.columns, base, occ, row], "of_row"), fresh([*docs.columns, base, occ, row], "added_spans")
    added = found.groupBy(F.col("row").alias(of_row)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(more))
    # of overlapping ones the first stays; a row's spans are bounded by its text
    seed = F.expr("struct(cast(array() as array<struct<start:bigint,end:bigint>>) as kept, -1L as last)")
    apart = F.aggregate(F.col(more), seed, lambda a, x: F.when(x["start"] >= a["last"], F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), x["end"].alias("last"))).otherwise(a), lambda a: a["kept"])
    extra = F.transform(F.coalesce(apart, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")), lambda x: F.struct(F.lit(CONTEXT).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    spans = fresh([*docs.columns, base, occ, row], "all_spans")
    joined = table.join(added, F.col(row) == F.col(of_row), "left")
    return joined.select(*(f"`{c}`" for c in keep), base, F.concat(F.col(base), extra).alias(spans)), base, spans


def _text(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def personal_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    rows, base, spans = find_personal(docs, text_col=text_col, keep=[id_col], **kw)

    def count(of: str, kind: str) -> Column:
        return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long")

    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), *(count(base, k).alias(f"n_{k}") for k in KINDS), F.sha2(_text(base), 256).alias("base_sha256"), _text(spans).alias("spans"), count(spans, CONTEXT).alias("n_context"))


def masked(text: str | None, spans: list[dict] | None) -> str | None:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the earlier, then longer, counts."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= at:
            continue
        out.append(text[at : max(at, s["start"])])
        if s["start"] >= at:
            out.append(f"<{s['kind'].upper()}>")
        at = s["end"]
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", **kw) -> DataFrame:
    """docs with personal data in the text masked, and the character count, where there is one, renewed."""
    rows, base, spans = find_personal(docs, text_col=text_col, keep=docs.columns, **kw)
    names = rows.columns
    at, sp = names.index(text_col), names.index(spans)
    chars = names.index(chars_col) if chars_col in docs.columns else -1
    width = len(docs.columns)
    schema = docs.schema

    def run(batches):
        for b in batches:
            arrays = list(b.columns[:width])
            texts = [masked(t, s) for t, s in zip(b.column(at).to_pylist(), b.column(sp).to_pylist(), strict=True)]
            arrays[at] = pa.array(texts, type=b.column(at).type)
            if chars >= 0:
                arrays[chars] = pa.array([None if t is None else len(t) for t in texts], type=b.column(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)
