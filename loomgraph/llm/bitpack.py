"""Operator 1, token-id output: fixed-width bit packing with block offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import lists, per_slice, small_batches, type_name
from .vocabulary import DEFAULT_VOCABULARY, library_chunks, vocabulary_size

BLOCK = 1024


def bit_width(vocabulary: int) -> int:
    """Fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, lengths: np.ndarray, bits: int) -> list[bytes]:
    """Pack several id sequences, lying one after the other in `ids`, least significant bit first.

    64 ids fill `bits` whole 64-bit words, so the ids are laid out in rows of 64 and each of the 64
    columns is shifted into its place for all rows at once."""
    rows = -(-lengths // 64)
    starts = np.concatenate([[0], np.cumsum(rows)])
    flat = np.zeros(int(starts[-1]) * 64, np.uint64)
    flat[np.arange(len(ids)) + np.repeat(starts[:-1] * 64 - (np.cumsum(lengths) - lengths), lengths)] = ids
    grid, words = flat.reshape(-1, 64), np.zeros((int(starts[-1]), bits), "<u8")
    for column in range(64):
        word, shift = divmod(column * bits, 64)
        words[:, word] |= grid[:, column] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= grid[:, column] >> np.uint64(64 - shift)
    data = words.tobytes()
    return [data[s : s + -(-n * bits // 8)] for s, n in zip((starts[:-1] * bits * 8).tolist(), lengths.tolist())]


def unpack(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """ids start..stop of a packed sequence; no other bytes are read."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(packed, np.uint8, count=-(-stop * bits // 8) - first, offset=first)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    at = np.arange(start, stop, dtype=np.int64) * bits - first * 8
    value = np.zeros(stop - start, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def unpack_blocks(packed: bytes, bits: int, n_tokens: int, offsets: list[int], first: int, last: int, block: int = BLOCK) -> np.ndarray:
    """ids of the blocks first..last-1, found by the stored offsets."""
    stop = min(last * block, n_tokens)
    end = offsets[last] if last < len(offsets) else len(packed)
    return unpack(packed[offsets[first] : end], bits, 0, stop - first * block)


def packed_tokens(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a document: (id, n_tokens, bits, block_offsets, packed).

    Each id takes the vocabulary's minimum number of bits. `block_offsets` has the byte at which each
    block of `block` ids begins (a multiple of 64 ids, so every block begins at a whole byte); `unpack`
    and `unpack_blocks` read any range with numpy. No shuffle: tokenising and packing happen in one pass
    where the text is read.

    A null text gives nulls in all columns but the id and `bits`; an empty text gives 0 tokens, no
    offsets and no bytes. Texts of any length are packed whole."""
    if block % 64:
        raise ValueError("block must be a multiple of 64")
    bits = bit_width(vocabulary_size(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        null = np.array([t is None for t in texts], bool)
        data = library_chunks(vocabulary).join(texts)
        lengths = np.fromiter(map(len, data), np.int64, len(data)) // 4
        packed = pack(np.frombuffer(b"".join(data), "<u4"), lengths, bits)
        blocks = -(-lengths // block)
        within = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(lengths.astype(np.int32), mask=null),
                pa.array(np.full(len(texts), bits, np.int32)),
                lists((within * (block * bits // 8)).astype(np.int32), blocks, null),
                pa.array([None if n else p for n, p in zip(null, packed)], pa.binary()),
            ],
            names=[id_col, "n_tokens", "bits", "block_offsets", "packed"],
        )

    schema = f"`{id_col}` {type_name(df, id_col)}, n_tokens int, bits int, block_offsets array<int>, packed binary"
    return small_batches(df).select(id_col, text_col).mapInArrow(per_slice(run), schema)
