"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter a language, stored bit-sliced: slot j holds a word with one bit for each
language, so a look-up of an n-gram is an AND of a few slots and returns the set of all
languages that may contain it. A text's n-grams are looked up at once; the number of
n-grams that hit each language is a popcount down that language's bit, corrected for the
false positives that its filter's fill predicts. The language with most wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import textvec
from larkspur.llm.common import raw_texts, slices, staged, with_added

#: Bytes in an n-gram, probes of a look-up, log2 of the slots.
GRAM, PROBES, LOG_SLOTS = 4, 2, 20
#: Expected number of texts of each language that train the filters.
SAMPLE_PER_LANGUAGE = 400
UNDETERMINED = "und"

_TO_LETTERS = bytes(b if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256)).lower()
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of lower-cased letters; all else is a space and an n-gram has one at most."""
    b = np.frombuffer(data.translate(_TO_LETTERS), dtype=np.uint8)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    packed = np.lib.stride_tricks.as_strided(b, (n, GRAM), (1, 1)).copy().view(np.uint32).ravel() if GRAM == 4 else None
    blank = (b == 32).astype(np.int8)
    spaces = sum((blank[i : n + i] for i in range(1, GRAM)), blank[:n])
    at = np.flatnonzero(spaces <= 1)
    return np.searchsorted(offsets, at, side="right") - 1, packed[at].astype(np.uint64)


@dataclass(frozen=True)
class Filters:
    """The languages, the bit-sliced slots (slots x words) and each language's share of false positives."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def probe(gram: np.ndarray, k: int) -> np.ndarray:
        return (gram + np.uint64(1)) * _MIX[k] >> np.uint64(64 - LOG_SLOTS)

    @classmethod
    def of(cls, languages: list[str], slot: np.ndarray, word: np.ndarray, bits: np.ndarray) -> Filters:
        """Filters from distinct (slot, word) and the word's bits."""
        slots = np.zeros((1 << LOG_SLOTS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        slots[slot, word] = bits
        fill = np.array([np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
        return cls(languages, slots, fill**PROBES)

    def sets(self, gram: np.ndarray) -> np.ndarray:
        """The bit mask of languages that may contain each n-gram."""
        out = self.slots[self.probe(gram, 0)]  # a copy
        for k in range(1, PROBES):
            out &= self.slots[self.probe(gram, k)]
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        letters = np.array([has_letter(t) for t in texts], dtype=bool)
        count = len(self.languages)
        for begin, end in slices(texts) if count else ():
            data, offsets = textvec.joined(texts[begin:end])
            row, gram = grams(data, offsets)
            masks = self.sets(gram)
            every = np.bincount(row, minlength=end - begin)
            hits = np.empty((end - begin, count))
            for i in range(count):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] = np.bincount(row, bit, minlength=end - begin)
            true = np.maximum(hits - every[:, None] * self.false_positive, 0) / (1 - self.false_positive)
            best[begin:end] = true.argmax(axis=1)
            total = true.sum(axis=1)
            score[begin:end] = np.where(total > 0, true.max(axis=1) / np.maximum(total, 1e-12), 1 / count)
        named = [self.languages[b] if count and ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        return named, np.where(letters & (count > 0), score, 0.0)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, ratio: float = 0.5, least: int = 2) -> Filters:
    """Filters from about per_language texts of each language, by a hash of id and text; pass docs without held-out rows.

    An n-gram enters every language in which its rate is at least `ratio` of its highest rate. Every
    language gets a filter. Null languages teach nothing; null and empty texts and texts without
    n-grams add none; repeated rows are sampled together; an empty table gives no languages, and then every
    text is `und`. Other columns do not matter. The bits are set in the engine: what reaches the
    driver is a number for each slot and 64 languages.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`")
    h = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), text, F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sizes = docs.where(lang.isNotNull()).groupBy(lang.alias("lang")).agg(F.count("*").alias("n"), F.min(h).alias("low")).orderBy("lang").collect()  # one row a language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Filters.of([], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))
    index = docs.sparkSession.createDataFrame([(r["lang"], i, min(1.0, per_language / r["n"]), r["low"]) for i, r in enumerate(sizes)], "lang string, i int, share double, low double")
    part = docs.select(lang.alias("lang"), h.alias("h"), text.alias("text")).join(F.broadcast(index), "lang").where("h < share or h <= low").select("i", "text")

    def count(batches):
        for b in batches:
            texts, of = raw_texts(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            for begin, end in slices(texts):
                data, offsets = textvec.joined(texts[begin:end])
                row, gram = grams(data, offsets)
                key, n = np.unique((of[begin:end][row].astype(np.uint64) << np.uint64(32)) | gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    counts = part.mapInArrow(count, "key long, n long").groupBy(F.shiftright("key", 32).alias("i"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("gram")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = staged(counts, "grams")
    rates = counts.join(F.broadcast(counts.groupBy("i").agg(F.sum("n").alias("all"))), "i").withColumn("rate", F.col("n") / F.col("all"))  # one row a language
    tops = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("i", "rate")).alias("of"))  # one entry a language
    members = tops.select("gram", F.explode(F.filter("of", lambda x: x["rate"] >= ratio * F.col("top"))).alias("m")).select("gram", F.col("m.i").alias("i"))

    def slots_of(batches):
        for b in batches:
            gram, i = b.column(0).to_numpy().astype(np.uint64), b.column(1)
            for k in range(PROBES):
                yield pa.RecordBatch.from_arrays([pa.array(Filters.probe(gram, k).astype(np.int64)), i], names=["slot", "i"])

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % 64).cast("int"))
    got = members.mapInArrow(slots_of, "slot long, i long").groupBy("slot", F.floor(F.col("i") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    return Filters.of(languages, *(got[n].to_numpy().astype(np.int64) for n in ("slot", "word")), got["bits"].to_numpy().astype(np.int64).view(np.uint64))


def identify(docs: DataFrame, filters: Filters, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs plus language and score of the whole text; `und` and 0 for null texts and texts without a letter.

    Of languages with equal counts the first by code point wins. Repeated rows get equal results, an
    empty table none; columns named like the new ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for each 64 languages

    def run(column: pa.Array) -> list[pa.Array]:
        names, score = held.value.predict(raw_texts(column))
        return [pa.array(names, type=pa.string()), pa.array(score)]

    return with_added(docs, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())], text_col, run)
