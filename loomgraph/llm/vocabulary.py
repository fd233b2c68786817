"""Rank-file vocabularies and a text coder that encodes each distinct chunk of text once.

A chunk is what lies between two spaces that start a word. The split pattern never joins text across such
a space, so a text's ids are the ids of its chunks one after the other; `Chunks` therefore keeps the
values of chunks it has met in a bounded memo, and a text costs one look-up a chunk.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: White space as the vocabularies' split pattern understands it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Chunks in one generation of a worker's memo.
MEMO = 150_000

_WIDE = re.compile(r" \s")
_CUT = re.compile(f" (?=[^{SPACE}])")


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def vocabulary_size(path: str) -> int:
    """Highest id + 1."""
    return max(load_ranks(path).values()) + 1


@lru_cache(4)
def library_encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def chunks(text: str) -> list[str]:
    """The first chunk as it is, the others without the space before them."""
    return text.split(" ") if not _WIDE.search(text) else _CUT.split(text)


def with_space(text: str | None) -> list[str]:
    """A text's chunks, each with the space that it begins with."""
    if not text:
        return []
    parts = chunks(text)
    return [*parts[:1], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]


def utf8(text: str) -> bytes:
    """A lone surrogate, which UTF-8 can't hold, becomes "?"."""
    return text.encode("utf-8", "replace") if not text.isascii() else text.encode()


class Chunks:
    """Values of chunks, as bytes that are joined to make a text's value.

    Values are kept in two generations: when the younger is full it takes the place of the older, so
    what a worker holds is bounded, and chunks that keep coming stay."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def make(self, new: list[str]) -> dict[str, bytes]:
        raise NotImplementedError

    def join(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > MEMO:
            self.old, self.known = self.known, {}
        split = [with_space(t) for t in texts]
        known, old, new = self.known, self.old, []
        for chunk in set().union(*split).difference(known):
            if (value := old.get(chunk)) is None:
                new.append(chunk)
            else:
                known[chunk] = value
        known.update(self.make(new))
        return [b"".join(map(known.__getitem__, parts)) for parts in split]


class LibraryChunks(Chunks):
    """ids (little-endian uint32) by the tokenizer library; new chunks that start a word are encoded in one call."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder = library_encoder(path)
        ranks = load_ranks(path)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def make(self, new: list[str]) -> dict[str, bytes]:
        out, together = {}, []
        for chunk in new:
            if chunk[0] == " " and len(chunk) > 1 and not chunk[1].isspace():
                together.append(chunk)
            else:
                out[chunk] = np.array(self.encoder.encode_ordinary(utf8(chunk).decode()), "<u4").tobytes()
        joined = "".join(together)
        ids = self.encoder.encode_to_numpy(joined if joined.isascii() else utf8(joined).decode(), disallowed_special=())
        ends = np.cumsum(np.fromiter((len(utf8(c)) for c in together), np.int64, len(together)))
        cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1).tolist() if len(ids) else []
        data, at = ids.astype("<u4").tobytes(), 0
        for chunk, cut in zip(together, cuts):
            out[chunk] = data[4 * at : 4 * cut]
            at = cut
        return out


@lru_cache(4)
def library_chunks(path: str) -> LibraryChunks:
    return LibraryChunks(path)
