"""Operator 7, language ID by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import codes, give_back, per_slice, small_batches, type_name

SLOTS_BITS, HASHES, N = 21, 2, 4
UNKNOWN = "und"
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def ngram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of four letters, of which the outer ones may be word ends, and the text it is in."""
    flat, sizes = codes([f" {t} " for t in texts])
    if len(flat) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = letters()[flat]
    n = len(flat) - N + 1
    good = (flat[1 : n + 1] != 32) & (flat[2 : n + 2] != 32)
    ends = np.cumsum(sizes)
    # an n-gram over the border of two texts has two spaces in a row, of which one is in the middle
    at = np.flatnonzero(good)
    value = np.zeros(len(at), np.uint64)
    for j in range(N):
        value += flat[at + j].astype(np.uint64) * _WEIGHTS[j]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value, np.searchsorted(ends, at, side="right")


def slots(value: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOTS_BITS) - 1)
    return [(value >> np.uint64(SLOTS_BITS * k) & mask).astype(np.int64) for k in range(HASHES)]


class Filters:
    """A slot array; bit l of a slot belongs to the filter of language l. A lookup is the AND of a few
    slots and tells all languages at once. Beyond 64 languages there is an array for each 64 of them."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        width = next((w for w in (8, 16, 32) if len(languages) <= w), 64)
        self.tables = [np.zeros(1 << SLOTS_BITS, f"u{width // 8}") for _ in range(0, max(1, len(languages)), 64)]

    def add(self, language: int, value: np.ndarray) -> None:
        table = self.tables[language // 64]
        for at in slots(value):
            table[at] |= table.dtype.type(1 << language % 64)

    @staticmethod
    def bit(words: np.ndarray, language: int) -> np.ndarray:
        return (words >> words.dtype.type(language % 64)) & words.dtype.type(1)

    def false_rates(self) -> np.ndarray:
        return np.array([np.mean(self.bit(self.tables[i // 64], i)) ** HASHES for i in range(len(self.languages))])

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each text, and by text and language the share that the language has, freed
        from the hits that are expected of n-grams it hasn't."""
        value, text = ngram_hashes(texts)
        first, *rest = slots(value)
        total = np.bincount(text, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        for i, rate in enumerate(self.false_rates()):
            if i % 64 == 0:
                masks = self.tables[i // 64][first]
                for at in rest:
                    masks &= self.tables[i // 64][at]
            hits = np.bincount(text, weights=self.bit(masks, i), minlength=len(texts))
            out[:, i] = np.clip((hits - total * rate) / (1 - rate) / np.maximum(total, 1), 0, 1)
        return total, out


def train(df: DataFrame, docs_per_language: int = 1500, least_count: int = 3, least_ratio: float = 0.2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Filters:
    """Filters from labelled rows: for each language about `docs_per_language` whole documents, chosen by a hash
    of their id and text (the documented bound of the training sample). An n-gram is added to a language if it comes up at
    least `least_count` times there and its share of the language's n-grams is at least `least_ratio` of its
    largest share in any language, so that stray foreign passages don't count. Every label with a text is a language,
    however rare: `least_count` is for a full sample and is less in proportion for a smaller one, and a share that
    others are held against is taken a standard error lower, so that few documents don't take n-grams from a large
    language. Null labels and texts are left out. What reaches the driver is bounded by the sample, not by the table."""
    labelled = small_batches(df).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r.l: r["count"] for r in labelled.groupBy("l").count().collect()}
    languages = sorted(sizes)
    model = Filters(languages)
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, docs_per_language / sizes[l]))])
    least = F.array(*[F.lit(max(1, math.ceil(least_count * min(1.0, sizes[l] / docs_per_language)))) for l in languages])
    sample = labelled.where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20))

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, text = ngram_hashes(batch.column(1).to_pylist())
        number = {l: i for i, l in enumerate(languages)}
        own = np.array([number[l] for l in batch.column(0).to_pylist()], np.int64)[text]
        parts = [(i, *np.unique(value[own == i], return_counts=True)) for i in np.unique(own).tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(len(v), i, np.int32) for i, v, _ in parts] or [np.zeros(0, np.int32)])),
                pa.array(np.concatenate([v.view(np.int64) for _, v, _ in parts] or [np.zeros(0, np.int64)])),
                pa.array(np.concatenate([c for _, _, c in parts] or [np.zeros(0, np.int64)]).astype(np.int64)),
            ],
            names=["l", "h", "n"],
        )

    counted = sample.select("l", "t").mapInArrow(per_slice(grams, 2000), "l int, h bigint, n bigint").groupBy("l", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("l")])
    found = counted.toPandas()
    total = found.groupby("l").n.transform("sum")
    found["share"], found["rival"] = found.n / total, (found.n - np.sqrt(found.n)) / total
    found = found[found.share >= least_ratio * found.groupby("h").rival.transform("max")]
    for i in range(len(languages)):
        model.add(i, found.h[found.l == i].to_numpy().view(np.uint64))
    return model


def identify(df: DataFrame, model: Filters, least_share: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id, language, share, second, n_grams): the language that has the largest corrected
    share of the document's n-grams, that share, and the share of the runner-up.

    A document is rejected, with language "und", if no language reaches `least_share` (other languages, digits, markup)
    or it has no n-gram at all, as empty texts have none; of equal shares the first language by name is taken. A
    null text gives nulls. Texts are read whole. No shuffle; the filters' size is fixed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        null = np.array([t is None for t in texts], bool)
        total, shares = model.shares([t or "" for t in texts])
        if not model.languages:
            shares = np.zeros((len(texts), 1))
        best = shares.argmax(1)
        top = shares[np.arange(len(texts)), best]
        names = [UNKNOWN if s < least_share or not t else model.languages[b] for b, s, t in zip(best.tolist(), top.tolist(), total.tolist())]
        second = np.sort(shares, 1)[:, -2] if shares.shape[1] > 1 else np.zeros(len(texts))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([None if n else x for n, x in zip(null, names)], pa.string()),
                pa.array(top, mask=null),
                pa.array(second, mask=null),
                pa.array(total.astype(np.int32), mask=null),
            ],
            names=[id_col, "language", "share", "second", "n_grams"],
        )

    schema = f"`{id_col}` {type_name(df, id_col)}, language string, share double, second double, n_grams int"
    return small_batches(df).select(id_col, text_col).mapInArrow(per_slice(run, 1000), schema)


def keep_identified(df: DataFrame, model: Filters, least_share: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not rejected; rows with a null text go as well. Texts are read whole. A model without
    languages, as of a table without labels, rejects only texts without n-grams."""
    names = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(names.index(text_col)).to_pylist()
        total, shares = model.shares([t or "" for t in texts])
        good = ((shares.max(1, initial=0) >= least_share) | (not model.languages)) & (total > 0)
        return batch.filter(pa.array(good))

    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield run(batch.slice(at, 1000))
        give_back()

    # columns go under numbers, as Python functions don't take every name
    plain = small_batches(df).toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(parts, plain.schema).toDF(*names)
