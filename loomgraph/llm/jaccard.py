"""Operator 10, n-gram Jaccard join: a grouped prefix join.

Two sets with Jaccard similarity of at least t share two of their first |x| - ceil(t |x|) + 2 elements under
any common order (sets that can only share one are equal then, and so in one group). The order here is by how often an element's bucket comes up in the whole corpus, rare first, so
that what many documents share comes last. Documents of one prefix and size form a group, and those of one
set a unit within it; candidates are pairs of groups, and members are verified as pairs of units, so
copies cost nothing but their id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import give_back, slices, small_batches, type_name
from .shared import checkpointed, components, spanning, written
from .vocabulary import MEMO

N, THRESHOLD = 2, 0.7
#: Buckets of the frequency sketch, in bits. One byte a bucket reaches the workers, whatever the corpus's size.
BUCKETS_BITS, _PIECES = 24, 64
MARKS = ".,;:!?\"'()[]{}«»“”„…-"
#: Documents from which on an element is so frequent that its rows are split by bands of set sizes.
HOT = 100_000
#: Groups that a task remembers having sent; rows of prefix elements that are compared at once.
SEEN, CHUNK = 200_000, 100_000
#: Units of one component that are verified together; bytes of their sets that a task sends at once.
BLOCK, SENT = 1000, 8 << 20
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest((word.strip(MARKS) or word).encode("utf-8", "replace"))
        return value


class _Hasher:
    """Sets of n-gram hashes; the hashes of words that keep coming are remembered."""

    def __init__(self, n: int):
        self.n, self.words = n, _Words()

    def sets(self, text: str) -> np.ndarray:
        words = text.lower().split()
        flat = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(self.words) > MEMO:
            self.words.clear()
        n = min(self.n, len(flat))
        if not n:
            return flat
        total = np.zeros(len(flat) - n + 1, np.uint64)
        for j in range(n):
            total = (total ^ flat[j : j + len(total)]) * _PRIMES[j % len(_PRIMES)]
            total ^= total >> np.uint64(31)
        return np.unique(total)


def _prefix(values: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The first elements in the common order that a partner must share one of."""
    size = len(values)
    keep = min(size, size - _least(threshold, size) + 2)
    by = counts[(values >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)]
    if keep < size:
        first = np.argpartition(by, keep - 1)
        limit = by[first[keep - 1]]
        sure, ties = np.flatnonzero(by < limit), np.flatnonzero(by == limit)  # values are sorted, so ties are in order
        chosen = np.concatenate([sure, ties[: keep - len(sure)]])
    else:
        chosen = np.arange(size)
    return values[chosen[np.lexsort((values[chosen], by[chosen]))]]


def _least(threshold: float, size: int) -> int:
    return max(1, int(np.ceil(threshold * size - 1e-9)))


def _identity(values: np.ndarray, prefix: np.ndarray) -> tuple[int, int]:
    """Of the group and the unit."""
    group = xxhash.xxh3_64_intdigest(prefix.tobytes() + len(values).to_bytes(8, "little")) - (1 << 63)
    return group, xxhash.xxh3_64_intdigest(values.tobytes(), 7) - (1 << 63)


def _packed(values: np.ndarray) -> bytes:
    """The upper 48 bits of each: within a pair of sets of a thousand, two of them are alike by chance once in 10^8 pairs."""
    return np.ascontiguousarray((values >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _levels(texts: DataFrame, n: int) -> np.ndarray:
    """How often the elements of each bucket come up over all documents, in eighths of a power of two.

    A task counts all its documents in one array and sends it packed, in pieces that are added up elsewhere; an
    array is mostly small numbers, so this is far less than the elements themselves."""

    def packed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for piece, part in enumerate(total.reshape(_PIECES, -1)):
            if part.any():
                # all low bytes, then all high ones, which are alike
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(part.view(np.uint8).reshape(-1, 2).T.tobytes(), 1)], pa.binary())], names=["piece", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, seen = _Hasher(n), np.zeros(1 << BUCKETS_BITS, np.uint16), 0
        for batch in slices(batches, 1000, column=0):
            for text in batch.column(0).to_pylist():
                buckets = (hasher.sets(text) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)  # sorted
                total[buckets[np.flatnonzero(np.diff(buckets, prepend=-1))]] += np.uint16(1)
            seen += batch.num_rows
            if seen > 60_000:  # before a counter is full
                yield from packed(total)
                total[:], seen = 0, 0
        yield from packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.ascontiguousarray(np.frombuffer(zlib.decompress(data.as_py()), np.uint8).reshape(2, -1).T).view(np.uint16).ravel()
                total[piece] = total[piece] + part if piece in total else part.astype(np.uint64)
        for piece, counts in total.items():
            level = np.minimum(np.round(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["piece", "data"])

    schema = "piece int, data binary"
    levels = np.zeros((_PIECES, (1 << BUCKETS_BITS) // _PIECES), np.uint8)
    for row in texts.mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).collect():
        levels[row.piece] = np.frombuffer(zlib.decompress(row.data), np.uint8)
    return levels.ravel()


def _banded(token: np.ndarray, level: np.ndarray, size: np.ndarray, threshold: float, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, visits): the keys under which a row of a prefix element is compared. A rare element is its own key. A
    hot one has a key for each band of set sizes; as a partner is in the same band or the next larger one, a row goes to
    its own band and as a visitor, which doesn't meet other visitors, to the next."""
    row, key, visits = np.arange(len(token)), token.copy(), np.zeros(len(token), bool)
    at = np.flatnonzero(level >= 8 * np.log2(hot + 1.0))
    if len(at):
        band = np.floor(np.log(size[at]) / -np.log(threshold) + 1e-6).astype(np.int64)
        mixed = lambda b: (token[at].view(np.uint64) ^ (b.astype(np.uint64) + np.uint64(1)) * _PRIMES[1]) * _PRIMES[0]
        key[at] = mixed(band).view(np.int64)
        row, key, visits = np.concatenate([row, at]), np.concatenate([key, mixed(band + 1).view(np.int64)]), np.concatenate([visits, np.ones(len(at), bool)])
    return row, key, visits


class _GroupPairs:
    """Pairs of groups that share a prefix element and may reach the threshold by their sizes and the element's places.

    Near copies share most of their prefix, and would be found once for each of its elements. `prev` stands for the
    two elements before (24 bits each). An element that both have behind different ones counts 1; the one after it, if
    both have that too, counts 2; those that go on like this are left out. The first two elements that a pair
    shares always count, so pairs with a sum below 2, which share one element by chance, can be left out.

    Rows come sorted by key, size and group, and are compared chunk by chunk; what is held from one chunk to the next
    are the rows of the last key whose size is still near enough."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.held = [np.zeros(0, np.int64)] * 5

    def add(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """rows: key, group, size, place (of a visitor -1 - place), prev."""
        threshold, first = self.threshold, len(self.held[0])
        token, group, size, pos, prev = (np.concatenate([h, x.astype(np.int64)]) for h, x in zip(self.held, rows))
        if not len(token):
            return
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
        new[:first] = True
        token, group, size, pos, prev = token[new], group[new], size[new], pos[new], prev[new]
        visits = pos < 0
        pos = np.where(visits, -1 - pos, pos)
        run_of = np.concatenate([[0], np.cumsum(token[1:] != token[:-1])])
        key = run_of * (1 << 33) + size
        partner = np.searchsorted(key, run_of[first:] * (1 << 33) + np.ceil(size[first:] * threshold - 1e-9).astype(np.int64))
        number = np.arange(first, len(key)) - partner  # of partners that come before each new row
        ends = np.cumsum(number)
        at = 0
        while at < len(number):  # so many rows that their pairs fit in memory, one row at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, side="right")))
            n = number[at:to]
            b = np.repeat(np.arange(first + at, first + to), n)
            a = np.repeat(partner[at:to], n) + np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n)
            room = np.minimum(size[a] - pos[a], size[b] - pos[b]) + 1
            before = np.minimum(pos[a], pos[b])
            differ = prev[a] ^ prev[b]
            starts = (before == 0) | (differ >> 24 != 0)
            second = ~starts & ((before == 1) | (differ & 0xFFFFFF != 0))
            fits = (room >= threshold / (1 + threshold) * (size[a] + size[b]) - 1e-9) & (starts | second) & ~(visits[a] & visits[b])
            low, high, weight = np.minimum(group[a[fits]], group[b[fits]]), np.maximum(group[a[fits]], group[b[fits]]), np.where(starts[fits], 1, 2)
            order = np.lexsort((high, low))
            low, high, weight = low[order], high[order], weight[order]
            fresh = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
            total = np.add.reduceat(weight, fresh) if len(fresh) else weight
            yield pa.RecordBatch.from_arrays([pa.array(low[fresh]), pa.array(high[fresh]), pa.array(total.astype(np.int32))], names=["ga", "gb", "weight"])
            at = to
        hold = (run_of == run_of[-1]) & (size >= threshold * size[-1] - 1e-9)
        self.held = [x[hold] for x in (token, group, size, np.where(visits, -1 - pos, pos), prev)]


class _Sets:
    """The sets of one task, of which each element is replaced by its number among all that the task has."""

    def __init__(self, sets: dict[int, np.ndarray]):
        numbers = np.unique(np.concatenate(list(sets.values())), return_inverse=True)[1].astype(np.int32)
        self.of = dict(zip(sets, np.split(numbers, np.cumsum([len(x) for x in sets.values()])[:-1])))
        self.marked = np.zeros(int(numbers.max()) + 1, bool)

    def shared(self, one: int, others: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """How many elements a set has in common with each of the others, and how many are in either."""
        own, out = self.of[one], []
        self.marked[own] = True
        sets = [self.of[x] for x in others]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) >> 20)) + 1), len(sets)]  # about a million elements each
        for at, to in zip(cuts, cuts[1:]):
            size = sizes[at:to]
            out.append(np.add.reduceat(self.marked[np.concatenate(sets[at:to])], np.cumsum(size) - size, dtype=np.int64))
        self.marked[own] = False
        both = np.concatenate(out)
        return both, len(own) + sizes - both


def similar_units(df: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, units, pairs): members are (id, n), which say that a document has unit n's set of n-grams; units
    are (n, first, documents), the smallest id of a unit and its number of documents; pairs are (a, b, jaccard) of the
    numbers of different units that reach the threshold."""
    id_type = type_name(df, id_col)
    texts = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    counts = _levels(texts.select("t"), n)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (token null) and of prefix elements (id null), so that texts are read once for both. A task
        sends a group's prefix once, however many copies it meets."""
        hasher, seen = _Hasher(n), set()
        for batch in slices(batches, 1000):
            keep, groups, units, sizes, prefixes, owners = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                values = hasher.sets(text)
                if len(values):
                    prefix = _prefix(values, counts, threshold)
                    group, unit = _identity(values, prefix)
                    if group not in seen:
                        seen.add(group)
                        prefixes.append(prefix), owners.append(len(keep))
                    keep.append(i), groups.append(group), units.append(unit), sizes.append(len(values))
            if len(seen) > SEEN:
                seen.clear()
            lengths = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
            flat = np.concatenate(prefixes or [np.zeros(0, np.uint64)])
            own = np.repeat(np.array(owners, np.int64), lengths)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = flat.view(np.int64)
            prev = np.zeros(len(values), np.int64)
            short = values >> 7 & 0xFFFFFF
            prev[1:] = short[:-1] << 24
            prev[2:] |= short[:-2]
            groups, sizes = np.array(groups, np.int64), np.array(sizes, np.int32)
            level = counts[(flat >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)]
            row, key, visits = _banded(values, level, sizes[own].astype(np.int64), threshold, hot)
            own, rows = own[row], len(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.nulls(len(key), batch.column(0).type)]),
                    pa.array(np.concatenate([groups, groups[own]])),
                    pa.concat_arrays([pa.array(units, pa.int64()), pa.nulls(len(key), pa.int64())]),
                    pa.array(np.concatenate([sizes, sizes[own]])),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(key)]),
                    pa.concat_arrays([pa.nulls(rows, pa.int32()), pa.array(np.where(visits, -1 - pos[row], pos[row]).astype(np.int32))]),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(prev[row])]),
                ],
                names=["id", "g", "u", "size", "token", "pos", "prev"],
            )

    read = texts.mapInArrow(ids_of, f"id {id_type}, g bigint, u bigint, size int, token bigint, pos int, prev bigint")
    # one shuffle, of prefix elements by element; documents only pass through it, anywhere
    routed = read.repartition(F.coalesce("token", F.xxhash64("id", "u"))).sortWithinPartitions("token", "size", "g")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pairs, waiting, rows = ["id", "g", "u", "size", "gb"], _GroupPairs(threshold), [], 0

        def compared() -> Iterator[pa.RecordBatch]:
            kind, columns = waiting[0][0], [np.concatenate([w[1][i] for w in waiting]) for i in range(5)]
            for pair in pairs.add(columns):
                none = pa.nulls(pair.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(pair.num_rows, kind), pair.column(0), none, pair.column(2), pair.column(1)], names=names)

        for batch in batches:
            is_token = batch.column(4).is_valid()
            doc = batch.filter(pa.compute.invert(is_token))
            if doc.num_rows:
                yield pa.RecordBatch.from_arrays([doc.column(0), doc.column(1), doc.column(2), doc.column(3), pa.nulls(doc.num_rows, pa.int64())], names=names)
            tok = batch.filter(is_token)
            if tok.num_rows:
                waiting.append((batch.column(0).type, [tok.column(i).to_numpy() for i in (4, 1, 3, 5, 6)]))
                rows += tok.num_rows
            if rows >= CHUNK:
                yield from compared()
                waiting.clear()
                rows = 0
        if waiting:
            yield from compared()
        give_back()

    import pyarrow.compute  # noqa: F401

    # for a pair of groups, `size` is the weight by which it was found
    found = written(routed.mapInArrow(split, f"id {id_type}, g bigint, u bigint, size int, gb bigint"))
    documents = found.where("gb IS NULL").select("id", "g", "u").distinct()
    units = documents.groupBy("g", "u").agg(F.min("id").alias("first"), F.count("*").alias("documents"))
    units = written(units.withColumn("n", F.monotonically_increasing_id()))
    members = documents.join(units.select("g", "u", "n"), ["g", "u"]).select("id", "n")
    a, b = (units.select(F.col("g").alias("g" + x), F.col("n").alias(x)) for x in "ab")
    across = found.where("gb IS NOT NULL").groupBy(F.col("g").alias("ga"), "gb").agg(F.sum("size").alias("weight")).where("weight > 1").join(a, "ga").join(b, "gb").select("a", "b")
    within = a.join(b, (F.col("ga") == F.col("gb")) & (F.col("a") < F.col("b"))).select("a", "b")
    pairs = written(across.union(within))

    # The pairs of one component of candidates are verified in one place, where each set is sent once; large components are cut into blocks.
    member = components(spanning(pairs)).select(F.col("node").alias("n"), F.col("component").alias("c"))
    member = member.join(member.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "c")
    member = written(member.select("n", "c", F.pmod(F.xxhash64("n"), F.col("blocks")).alias("block")))
    of_a, of_b = (member.select(F.col("n").alias(x), "c", F.col("block").alias("block_" + x)) for x in "ab")
    task = F.xxhash64("c", F.least("block_a", "block_b"), F.greatest("block_a", "block_b"))
    placed = written(pairs.join(of_a, "a").join(of_b.drop("c"), "b").select(task.alias("task"), "a", "b"))
    sent = placed.select("task", F.col("a").alias("n")).union(placed.select("task", "b")).groupBy("n").agg(F.collect_set("task").alias("tasks"))
    sent = sent.join(units.select("n", "g", "u", F.col("first").alias("id")), "n")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(n)
        out: list[tuple[int, int, bytes]] = []

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.nulls(len(out), pa.int64())],
                names=["task", "a", "values", "b"],
            )

        size = 0
        for batch in slices(batches, 500, column=0):
            for text, unit, group, digest, where in zip(*(batch.column(i).to_pylist() for i in range(5))):
                values = hasher.sets(text)
                if len(values) and _identity(values, _prefix(values, counts, threshold)) == (group, digest):
                    data = _packed(values)
                    for task in where:  # a unit of a large component goes to many
                        out.append((task, unit, data))
                        size += len(data)
                        if size >= SENT:
                            yield gathered()
                            out.clear()
                            size = 0
        yield gathered()

    shipped = texts.join(sent, "id").select("t", "n", "g", "u", "tasks").mapInArrow(sets, "task bigint, a bigint, values binary, b bigint")
    asked = placed.select("task", "a", F.lit(None).cast("binary").alias("values"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task the sets come first (b null), then the pairs by b."""
        known: dict[int, np.ndarray] = {}
        task = sets = None
        for batch in batches:
            tasks, a, b, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(2)
            good, similarities, at = [np.zeros(0, np.int64)], [np.zeros(0)], 0
            while at < len(tasks):
                if tasks[at] != task:
                    task, sets = tasks[at], None
                    known.clear()
                if b[at] is None:
                    known[a[at]] = _unpacked(values[at].as_py())
                    at += 1
                    continue
                if sets is None:
                    sets = _Sets(known)
                    known.clear()
                to = at + 1
                while to < len(tasks) and b[to] == b[at] and tasks[to] == task:
                    to += 1
                shared, either = sets.shared(b[at], a[at:to])
                enough = np.flatnonzero(shared >= threshold * either - 1e-9)
                good.append(at + enough), similarities.append(shared[enough] / either[enough])
                at = to
            yield pa.RecordBatch.from_arrays([*batch.select([1, 3]).take(pa.array(np.concatenate(good))).columns, pa.array(np.concatenate(similarities))], names=["a", "b", "jaccard"])
        known.clear()
        sets = None
        give_back()

    verified = shipped.unionByName(asked).repartition("task").sortWithinPartitions("task", F.col("b").asc_nulls_first()).mapInArrow(verify, "a bigint, b bigint, jaccard double")
    return members, units, written(verified)


def jaccard_pairs(df: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, pairs), as described for jaccard_join: members are (id, representative), the smallest id of the
    documents that have the same set; pairs are (a, b, jaccard) of different representatives."""
    members, units, pairs = similar_units(df, n, threshold, id_col, text_col, hot)
    first_a, first_b = (units.select(F.col("n").alias(x), F.col("first").alias("first_" + x)) for x in "ab")
    named = pairs.join(first_a, "a").join(first_b, "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"), "jaccard")
    return members.join(units.select("n", "first"), "n").select(F.col("id").alias(id_col), F.col("first").alias("representative")), named.where("a <> b")


def jaccard_join(df: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row a document: (id, class_id, n_links): the number of other documents whose set of word n-grams has a
    Jaccard similarity of `threshold` at least with its own, and the smallest id among the documents that it is linked
    with, directly or through others; its own where that is the smallest. Every link counts: copies are
    counted, not expanded into pairs.

    Words are what lies between white space, in lower case, without punctuation at their ends. A text of
    fewer than n words has one n-gram, all its words. A document without words or with a null text is a class of its own;
    rows with a null id have no row in the result. Rows that repeat an id are one document that has each of its texts;
    links are counted text by text then, also those between its own.

    n-grams are compared by 64 bits of hash. Two steps use fewer: of neighbours in a prefix 24 bits are
    compared, and sets are verified by 48 bits an element; either can err by chance about once in 10^7 pairs. Nothing
    else is left out: there is no cap on partners, candidates or lengths."""
    members, units, pairs = similar_units(df, n, threshold, id_col, text_col, hot)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    others = both.join(units.select(F.col("n").alias("b"), "documents"), "b").groupBy(F.col("a").alias("n")).agg(F.sum("documents").alias("others"))
    # a document with several texts ties their units together
    first = members.groupBy("id").agg(F.min("n").alias("b"), F.max("n").alias("last")).where("b < last").select("id", "b")
    edges = pairs.select("a", "b").union(members.join(first, "id").select(F.col("n").alias("a"), "b").where("a <> b"))
    component = components(spanning(edges)).select(F.col("node").alias("n"), "component")
    of_unit = checkpointed(units.join(component, "n", "left").join(others, "n", "left").select("n", "first", F.coalesce("component", "n").alias("component"), (F.col("documents") - 1 + F.coalesce("others", F.lit(0))).alias("links")))
    least = of_unit.groupBy("component").agg(F.min("first").alias("class"))
    linked = members.join(of_unit.join(least, "component").select("n", "class", "links"), "n").select("id", "class", "links")
    alone = df.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    rows = linked.union(alone.select("id", F.col("id").alias("class"), F.lit(0).cast("bigint")))
    return rows.groupBy("id").agg(F.min("class").alias("class_id"), F.sum("links").alias("n_links")).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one_of_each_group(df: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, without those documents that jaccard_join puts in the class of
    a smaller id. Of rows that repeat an id and a text one is kept; rows with a null id and those with null texts or
    texts without words stay. Texts of any length are compared whole; an empty table stays empty."""
    linked = jaccard_join(df, n, threshold, id_col, text_col).where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("_"))
    kept = df.join(linked, F.col(f"`{id_col}`") == linked["_"], "left_anti").select([f"`{c}`" for c in df.columns])
    repeated = checkpointed(df.select(F.col(id_col).alias("_")).where("_ IS NOT NULL").groupBy("_").count().where("count > 1").select("_"))
    if repeated.isEmpty():
        return kept
    again = kept[id_col] == repeated["_"]
    twice = kept.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, again, "left_anti").union(twice)


def oracle(threshold: float = THRESHOLD) -> str:
    """For word bigrams."""
    marks = MARKS.replace("'", "''")
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''),
  lambda x: CASE WHEN trim(x, '{marks}') = '' THEN x ELSE trim(x, '{marks}') END) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w WHERE len(w) > 0),
u AS (SELECT s, min(doc_id) AS f, count(DISTINCT doc_id) AS m FROM s GROUP BY s),
e AS (SELECT f, len(s) AS n, unnest(s) AS t FROM u),
p AS (SELECT a.f AS a, b.f AS b FROM e a JOIN e b ON a.t = b.t AND a.f < b.f GROUP BY a.f, b.f, a.n, b.n HAVING count(*) >= {threshold} * (a.n + b.n - count(*)) - 1e-9),
x AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
o AS (SELECT a, sum(m) AS others FROM x JOIN u ON u.f = x.b GROUP BY a),
r(a, b) AS (SELECT a, b FROM x UNION SELECT r.a, x.b FROM r JOIN x ON x.a = r.b),
k AS (SELECT a, least(a, min(b)) AS k FROM r GROUP BY a)
SELECT d.doc_id, coalesce(k.k, u.f, d.doc_id) AS class_id, (coalesce(u.m, 1) - 1 + coalesce(o.others, 0))::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN u ON u.s = s.s LEFT JOIN k ON k.a = u.f LEFT JOIN o ON o.a = u.f"""
