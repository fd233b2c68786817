"""Operator 3, BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The last token of a word's BPE encoding, and the same for each of its prefixes, determines the whole
encoding: cutting that token off leaves a prefix, whose own last token goes on. For a prefix there is
exactly one token that ends it and may follow the last token of what remains, so the last tokens are
found from left to right. They depend on the prefix alone; words that share one share the work. Walking the
words in sorted order visits their trie depth first, with the states of the current path on a stack.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow import lists, per_slice, small_batches, type_name
from .vocabulary import DEFAULT_VOCABULARY, MEMO, SPACE, Chunks, load_ranks, utf8

PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class TrieEncoder:
    """BPE for a vocabulary whose ids are the ranks of its merges."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            pieces = self._merge_below(token, ranks, rank) if len(token) > 1 else []
            if len(pieces) == 2:
                self.parts[rank] = (pieces[0], pieces[1])
                self.pairs[pieces[0], pieces[1]] = rank
        self.compatible: dict[int, bool] = {}
        self._automaton(ranks)

    @staticmethod
    def _merge_below(token: bytes, ranks: dict[bytes, int], limit: int) -> list[int]:
        """Encoding of a token by the merges that come before its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
            if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def _automaton(self, ranks: dict[bytes, int]) -> None:
        """For each string that begins a token: the tokens that end it, longest first, and where a byte leads."""
        self.next: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for token, rank in ranks.items():
            state = 0
            for byte in token:
                to = self.next[state].get(byte)
                if to is None:
                    to = self.next[state][byte] = len(own)
                    self.next.append({})
                    own.append(-1)
                state = to
            own[state] = rank
        self.fall = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        queue = list(self.next[0].values())
        for state in queue:
            longer = self.ends[self.fall[state]]
            self.ends[state] = longer if own[state] < 0 else ((own[state], self.lengths[own[state]]), *longer)
            for byte, to in self.next[state].items():
                back = self.fall[state]
                while back and byte not in self.next[back]:
                    back = self.fall[back]
                self.fall[to] = self.next[back].get(byte, 0) if state else 0
                queue.append(to)

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they stand side by side.

        The merge that would join parts across the border, and comes before those that build the tokens
        themselves, is looked for by taking the token apart that was built later."""
        limit = 1 << 60
        while True:
            if self.pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, parts = left, self.parts.get(left)
                if parts:
                    left = parts[1]
                    continue
                limit, parts = right + 1, self.parts.get(right)
                if not parts:
                    return True
                right = parts[0]
            else:
                limit, parts = right + 1, self.parts.get(right)
                if parts:
                    right = parts[0]
                    continue
                limit, parts = left, self.parts.get(left)
                if not parts:
                    return True
                left = parts[1]

    def encode(self, words: set[bytes], counts: bool = False) -> dict[bytes, bytes]:
        """word -> its ids as little-endian uint32; with `counts`, word -> by how much each character
        changes the number of ids of the prefix that it ends, as signed bytes."""
        deepest = max(map(len, words), default=0) + 1
        last, number, states = [0] * deepest, [0] * deepest, [0] * deepest
        nexts, fall, ends, lengths, known = self.next, self.fall, self.ends, self.lengths, self.compatible
        out: dict[bytes, bytes] = {}
        before = b""
        for word in sorted(words):
            depth, shared = 0, min(len(word), len(before))
            while depth < shared and word[depth] == before[depth]:
                depth += 1
            before, state = word, states[depth]
            for byte in word[depth:]:
                depth += 1
                to = nexts[state].get(byte)
                while to is None:
                    state = fall[state]
                    to = nexts[state].get(byte)
                state = states[depth] = to
                for token, length in ends[state]:
                    rest = depth - length
                    if not rest:
                        break
                    key = last[rest] << 32 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = self._may_follow(last[rest], token)
                    if fits:
                        break
                last[depth], number[depth] = token, number[rest] + 1
            if counts:
                ends_at = number[1 : depth + 1] if word.isascii() else [number[d] for d in range(1, depth + 1) if d == depth or word[d] & 0xC0 != 0x80]
                out[word] = bytes([(b - a) & 255 for a, b in zip([0, *ends_at], ends_at)])
            else:
                ids = []
                while depth:
                    ids.append(token := last[depth])
                    depth -= lengths[token]
                ids.reverse()
                out[word] = array("I", ids).tobytes()
        if len(known) > 4 * MEMO:
            known.clear()
        return out


@lru_cache(4)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def pieces_of(chunk: str) -> list[str]:
    """The split pattern's pieces of a chunk; the two commonest shapes need no pattern."""
    bare = chunk[1:] if chunk[0] == " " else chunk
    if bare.isalpha():
        return [chunk]
    if bare[-1:] in (".", ",") and bare[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return PIECE.findall(chunk)


class TrieChunks(Chunks):
    """ids of chunks; the pieces of all chunks that a batch brings anew go through one trie together."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder = trie_encoder(path)

    def make(self, new: list[str]) -> dict[str, bytes]:
        split = [[utf8(p) for p in pieces_of(chunk)] for chunk in new]
        ids = self.encoder.encode(set().union(*split))
        return {chunk: b"".join([ids[p] for p in parts]) for chunk, parts in zip(new, split)}


@lru_cache(4)
def trie_chunks(path: str) -> TrieChunks:
    return TrieChunks(path)


@lru_cache(4)
def token_table(path: str) -> list[bytes]:
    by_rank = trie_encoder(path).bytes_of
    return [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]


def decode_ids(ids, path: str = DEFAULT_VOCABULARY) -> bytes:
    return b"".join(map(token_table(path).__getitem__, ids))


def encode_bpe(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id, n_tokens, ids), the ids that the vocabulary's own library gives.

    A null text gives nulls, an empty text no ids; texts are encoded whole. No shuffle. A lone surrogate is
    encoded as "?"."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        data = trie_chunks(vocabulary).join(texts)
        null = np.array([t is None for t in texts], bool)
        lengths = np.fromiter(map(len, data), np.int64, len(data)) // 4
        ids = np.frombuffer(b"".join(data), "<i4")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int32), mask=null), lists(ids, lengths, null)], names=[id_col, "n_tokens", "ids"])

    schema = f"`{id_col}` {type_name(df, id_col)}, n_tokens int, ids array<int>"
    return small_batches(df).select(id_col, text_col).mapInArrow(per_slice(run, 8000), schema)


def decode_bpe(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a sequence: (id, text). Null ids give a null text, no ids an empty one; bytes that are no
    UTF-8, which only a cut sequence can have, become U+FFFD. An id that the vocabulary lacks is an error."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        texts = [None if x is None else decode_ids(x, vocabulary).decode("utf-8", "replace") for x in column.to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = f"`{id_col}` {type_name(df, id_col)}, text string"
    return df.select(id_col, ids_col).mapInArrow(per_slice(run, 500), schema)


def encode_with_check(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_bpe, and whether decoding each row's ids gives its text back: (id, n_tokens, ids, restored)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        data = trie_chunks(vocabulary).join(texts)
        null = np.array([t is None for t in texts], bool)
        lengths = np.fromiter(map(len, data), np.int64, len(data)) // 4
        restored = [None if t is None else decode_ids(np.frombuffer(x, "<u4").tolist(), vocabulary) == utf8(t) for t, x in zip(texts, data)]
        ids = np.frombuffer(b"".join(data), "<i4")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int32), mask=null), lists(ids, lengths, null), pa.array(restored, pa.bool_())], names=[id_col, "n_tokens", "ids", "restored"])

    schema = f"`{id_col}` {type_name(df, id_col)}, n_tokens int, ids array<int>, restored boolean"
    return small_batches(df).select(id_col, text_col).mapInArrow(per_slice(run, 8000), schema)
