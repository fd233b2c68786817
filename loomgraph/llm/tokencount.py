"""Operator 6, token counts: the exact count at every prefix, by dynamic programming over prefixes.

The number of tokens of a prefix is that of the prefix without its last token, plus one (see bpe.py).
The counts of all prefixes of all distinct pieces come out of the same walk over their trie. A text's
table is the tables of its chunks one after the other, kept as differences, one signed byte a character."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import per_slice, small_batches, type_name
from .bpe import pieces_of, trie_encoder
from .vocabulary import DEFAULT_VOCABULARY, Chunks, utf8

#: Contractions whose prefix of two characters is no piece but two.
_SPLIT = ("'re", "'ve", "'ll")


class PrefixCounts(Chunks):
    """Tables of chunks; the pieces of all chunks that a batch brings anew go through one trie together."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder = trie_encoder(path)
        if self.encoder.longest > 128:
            raise ValueError("a token of more than 128 bytes could change a count by more than a byte holds")

    def make(self, new: list[str]) -> dict[str, bytes]:
        split = [pieces_of(chunk) for chunk in new]
        words = set().union(*split)
        for parts in split:
            if len(parts) > 1:
                words.update(a + b[0] for a, b in zip(parts, parts[1:]) if a.isspace() and b[0].isspace())
        by_bytes = self.encoder.encode({utf8(w) for w in words}, counts=True)
        table = {w: by_bytes[utf8(w)] for w in words}
        return {chunk: self._join(parts, table) for chunk, parts in zip(new, split)}

    @staticmethod
    def _join(parts: list[str], table: dict[str, bytes]) -> bytes:
        """Differences add up over pieces but for prefixes that the split pattern cuts in another way: white
        space that nothing follows yet is one piece, and a contraction that lacks its last letter is two."""
        joined = b"".join([table[p] for p in parts])
        runs = [k for k in range(len(parts) - 1) if parts[k].isspace() and parts[k + 1][0].isspace()]
        if not runs and not any(p in _SPLIT for p in parts):
            return joined
        real, at = np.cumsum(np.frombuffer(joined, np.int8), dtype=np.int64), 0
        counts = real.copy()
        for k, piece in enumerate(parts):
            base = int(real[at - 1]) if at else 0
            if piece in _SPLIT:
                counts[at + 1] = base + 2
            if k in runs:
                run = np.frombuffer(table[piece + parts[k + 1][0]], np.int8)
                counts[at + len(piece)] = base + int(run.sum(dtype=np.int64))
            at += len(piece)
        return np.diff(counts, prepend=0).astype(np.int8).tobytes()


@lru_cache(4)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def counts_of(table: bytes) -> np.ndarray:
    """Token count of every prefix: entry i is the count of the first i + 1 characters."""
    return np.cumsum(np.frombuffer(table, np.int8), dtype=np.int32)


def tokens_before(table: bytes, characters: int) -> int:
    """Tokens of the first `characters` characters."""
    return int(np.frombuffer(table, np.int8, count=min(characters, len(table))).sum(dtype=np.int64))


def longest_within(table: bytes, budget: int) -> int:
    """Length of the longest prefix that has at most `budget` tokens."""
    fits = np.flatnonzero(counts_of(table) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(df: DataFrame, budgets: tuple[int, ...] = (512, 2048), vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id, n_tokens, prefix_deltas, fits_<budget>...).

    The running sum of `prefix_deltas` (one signed byte a character) is, at character i, the exact number of
    tokens that encoding the first i characters gives; `fits_<budget>` is the length of the longest prefix
    within the budget. `tokens_before` and `longest_within` answer further questions from the table alone.

    A null text gives nulls; an empty one 0 tokens, an empty table and prefixes of length 0. Texts are
    counted whole. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        data = prefix_counts(vocabulary).join(texts)
        rows = [counts_of(x) for x in data]
        null = [t is None for t in texts]
        at_end = [None if n else int(r[-1]) if len(r) else 0 for n, r in zip(null, rows)]
        fits = []
        for budget in budgets:
            column = []
            for n, r in zip(null, rows):
                if n or not len(r) or r[-1] <= budget:
                    column.append(None if n else len(r))
                else:
                    within = np.flatnonzero(r <= budget)
                    column.append(int(within[-1]) + 1 if len(within) else 0)
            fits.append(pa.array(column, pa.int32()))
        tables = pa.array([None if n else x for n, x in zip(null, data)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(at_end, pa.int32()), tables, *fits], names=[id_col, "n_tokens", "prefix_deltas", *(f"fits_{b}" for b in budgets)])

    schema = f"`{id_col}` {type_name(df, id_col)}, n_tokens int, prefix_deltas binary" + "".join(f", fits_{b} int" for b in budgets)
    return small_batches(df).select(id_col, text_col).mapInArrow(per_slice(run, 8000), schema)
