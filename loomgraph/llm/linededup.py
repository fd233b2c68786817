"""Operator 8, line dedup: a join of deletion neighbourhoods.

Lines are compared by words, short ones by characters. Two lines are within one edit if they are equal or become so
by changing, adding or taking away one word (character); then a variant of the one (itself, or itself without one word)
is also a variant of the other. Variants are sent to the join as hashes; lines that meet there are verified
by their words, and the earliest stays.

A long line has as many variants as words, so lines that can't have a partner are left out first, without
loss: of two lines within one edit, the edit is in the first or the second half, and the other half is
the same in both. Only lines that share such a half with another line emit their variants.

What comes up in very many documents is aggregated before it is shuffled, and joined back to the lines by their
keys, where Spark can split a key that has too many of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, small_batches, type_name
from .shared import written

#: Lines of fewer words are compared by characters, and those of fewer characters too for equality only: one edit
#: is too much of them.
LEAST_WORDS, LEAST_CHARACTERS = 8, 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _hash(words: list[str], seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "replace"), seed) - (1 << 63)


def line_key(words: list[str]) -> tuple[int, int]:
    """128 bits that stand for a line."""
    digest = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "replace"))
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def line_check(line: str) -> int:
    """What Spark's xxhash64 gives for the line."""
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42)
    return value - (1 << 64) if value >> 63 else value


def units(line: str, least_words: int = LEAST_WORDS, least_characters: int = LEAST_CHARACTERS) -> tuple[list[str], bool] | None:
    """What a line is compared by: its words, or the characters of them with single spaces between (then True); None if it is
    compared for equality only."""
    words = line.split()
    if len(words) >= least_words:
        return words, False
    short = " ".join(words)
    return (list(short), True) if len(short) >= least_characters else None


def halves(words: list[str], characters: bool) -> list[int]:
    """Keys of which lines within one edit, that differ, share one: the halves of the line, and what the
    halves of a line that is shorter by a word would be."""
    n, kind = len(words), 2 * characters
    h, g = n // 2, (n - 1) // 2
    return [_hash(words[:h], 4 * n + kind), _hash(words[h:], 4 * n + 1 + kind), _hash(words[:g], 4 * (n - 1) + kind), _hash(words[g + 1 :], 4 * (n - 1) + 1 + kind)]


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two different sequences: whether they differ by one change, addition or removal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    differ = np.flatnonzero(a[: len(b)] != b)
    at = int(differ[0]) if len(differ) else len(b)
    return bool((a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])).all())


def variants(words: list[str], start: int, stop: int, characters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Two hashes of the line itself (place -1) and of the line without its word i, for start <= i < stop; the places; and the words' hashes.

    A hash is the sum of the words' hashes, each times a power that belongs to its place, so all come
    from two running sums. The length goes into it, so a variant only meets one of its own length."""
    n = len(words)
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"), characters) for w in words], np.uint64)
    sizes = np.full(stop - start + 1, n - 1, np.uint64)
    sizes[0] = n
    out = []
    for multiplier in _MULTIPLIERS:
        powers = np.cumprod(np.full(n, multiplier, np.uint64))
        here = np.concatenate([[np.uint64(0)], np.cumsum(h * powers)])
        left = np.concatenate([[np.uint64(0)], np.cumsum(h[1:] * powers[:-1])])
        sums = np.concatenate([here[-1:], here[start:stop] + (left[-1] - left[start:stop])]) + sizes * np.uint64(0x94D049BB133111EB)
        sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((sums ^ (sums >> np.uint64(32))).view(np.int64))
    return out[0], out[1], np.concatenate([[-1], np.arange(start, stop)]).astype(np.int32), h.tobytes()


def _range(n: int, roles: list[int]) -> tuple[int, int]:
    """Where the edit can be, given which halves (see `halves`) are shared with other lines."""
    h, g = n // 2, (n - 1) // 2
    spans = [((h, n), (0, h), (g, n), (0, g + 1))[role] for role in roles]
    return min(s for s, _ in spans), max(e for _, e in spans)


def repeated_lines(df: DataFrame, least_words: int = LEAST_WORDS, least_characters: int = LEAST_CHARACTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines): a document's lines, as (number, xxhash64 of the line), that come after an equal or near line."""
    id_type = type_name(df, id_col)
    texts = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            own, number, check, a, b, half = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, line in enumerate(text.split("\n")):
                    if words := line.split():
                        own.append(i), number.append(n), check.append(line_check(line))
                        x, y = line_key(words)
                        a.append(x), b.append(y)
                        by = units(line, least_words, least_characters)
                        half.append(by and halves(*by))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int32())), pa.array(number, pa.int32()), pa.array(check, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(half, pa.list_(pa.int64()))],
                names=["id", "line", "c", "a", "b", "halves"],
            )

    place = F.struct("id", "line", "c")
    read = written(texts.mapInArrow(keys, f"id {id_type}, line int, c bigint, a bigint, b bigint, halves array<bigint>"))
    # of equal lines the earliest stays for its kind, the others go
    earliest = written(read.groupBy("a", "b").agg(F.min(F.struct(place.alias("at"), "halves")).alias("m"), F.count("*").alias("n")).select("a", "b", "m.at", "m.halves", "n"))
    repeated = earliest.where("n > 1").select("a", "b", F.col("at").alias("first"))
    equal = read.select("a", "b", place.alias("at")).join(repeated, ["a", "b"]).where("at > first").select("at")
    shared = earliest.where("halves IS NOT NULL").select("at", F.posexplode("halves").alias("role", "half"))
    meets = shared.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    near = shared.join(meets, "half").groupBy("at").agg(F.collect_set("role").alias("roles"))
    wanted = near.groupBy(F.col("at.id").alias("id")).agg(F.collect_list(F.struct("at.line", "at.c", "roles")).alias("lines"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a variant; that of the whole line, with place -1, has its words' hashes too."""
        for batch in slices(batches, 500):
            found, own, numbers, checks = [], [], [], []
            for i, (text, lines) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                rows = text.split("\n")
                for x in lines:
                    if x["line"] < len(rows) and line_check(row := rows[x["line"]]) == x["c"]:
                        words, characters = units(row, least_words, least_characters)
                        found.append(variants(words, *_range(len(words), x["roles"]), characters))
                        own.append(i), numbers.append(x["line"]), checks.append(x["c"])
            if found:
                sizes = [len(f[0]) for f in found]
                words = [x for f in found for x in (f[3], *[None] * (len(f[0]) - 1))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.concatenate([f[k] for f in found])) for k in range(3)),
                        pa.array(words, pa.binary()),
                        batch.column(0).take(pa.array(np.repeat(own, sizes))),
                        pa.array(np.repeat(np.array(numbers, np.int32), sizes)),
                        pa.array(np.repeat(np.array(checks, np.int64), sizes)),
                    ],
                    names=["v", "w", "place", "words", "id", "line", "c"],
                )

    emitted = texts.join(wanted, "id").select("id", "t", "lines").mapInArrow(emit, f"v bigint, w bigint, place int, words binary, id {id_type}, line int, c bigint")
    emitted = written(emitted.select("v", "w", "place", "words", place.alias("at")))
    # Two lines that lack the same word and are equal then differ by a change of that word alone; one that lacks a
    # word and is then another whole line differs by that word. Lines that lack words at different places have
    # more than one edit between them, or meet in another variant too. So of each variant the earliest line that has it whole,
    # the earliest that has it by a cut, and the earliest by a cut at each place are all that others need to meet.
    # most variants are of one line only, and go before anything else
    several = emitted.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    meeting = emitted.drop("words").join(several, "v")
    same = meeting.groupBy("v", "w", "place").agg(F.min("at").alias("same"))
    variant = same.groupBy("v", "w").agg(F.min(F.when(F.col("place") < 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("same"))).alias("cut"))
    partners = F.when(F.col("place") < 0, F.array("cut")).otherwise(F.array("same", "whole"))
    met = meeting.join(same, ["v", "w", "place"]).join(variant, ["v", "w"]).select("at", F.explode(partners).alias("earlier")).where("earlier < at").distinct()
    words = emitted.where("place = -1").select("at", "words")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield batch.select([0]).filter(pa.array([within_one_edit(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs], pa.bool_()))

    of_earlier = words.select(F.col("at").alias("earlier"), F.col("words").alias("others"))
    at_type = met.schema["at"].dataType.simpleString()
    gone = met.join(words, "at").join(of_earlier, "earlier").select("at", "words", "others").mapInArrow(verified, f"at {at_type}")
    return equal.union(gone).groupBy("at.id").agg(F.collect_set(F.struct("at.line", "at.c")).alias("lines"))


def dedup_lines(df: DataFrame, least_words: int = LEAST_WORDS, least_characters: int = LEAST_CHARACTERS, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows, with all their columns, their texts without repeated lines; `count_col`, if given, says how many went.

    A line goes if an earlier line of the corpus, by id and line number, is equal or within one edit of it, also if
    that one goes itself; so the earliest of each set of copies stays. Lines are compared by words, what lies between
    white space: one edit changes, adds or takes away a word. Lines of fewer than `least_words` words are compared with each
    other by characters, the spaces between words made single ones; those of fewer than `least_characters` as well
    only for equality, as one edit is too much of them. Lines without words stay.

    Null texts and rows with a null id stay as they are; an empty text has no lines to lose; a text that loses all
    its lines becomes empty. Rows that repeat an id share their places: equal lines at one place of both
    stay in both. Lines of any length are compared whole. `count_col` must not be a column already."""
    if count_col in df.columns:
        raise ValueError(f"there is a column {count_col} already")
    lines = repeated_lines(df, least_words, least_characters, id_col, text_col).select(F.col("id").alias("i"), F.col("lines").alias("gone"))
    # the row goes as one column, so no name of its own can clash
    own = lambda c: F.col("row").getField(c)
    text, gone = own(text_col), F.col("gone")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.exists(gone, lambda z: (z["line"] == i) & (z["c"] == F.xxhash64(x))))
    new = F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).join(lines, own(id_col) == F.col("i"), "left")
    columns = [(new if c == text_col else own(c)).alias(c) for c in df.columns]
    if count_col:
        columns.append(F.coalesce(F.size(F.when(gone.isNotNull(), F.split(text, "\n", -1))) - F.size(kept), F.lit(0)).alias(count_col))
    return out.select(columns)


def oracle(least_words: int = LEAST_WORDS, least_characters: int = LEAST_CHARACTERS) -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
w AS (SELECT doc_id, i, line, doc_id * 10000000 + i AS pos, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT w, min(pos) AS f FROM w WHERE len(w) > 0 GROUP BY w),
u AS (SELECT f, false AS c, w AS u FROM k WHERE len(w) >= {least_words}
  UNION ALL SELECT f, true, string_split(array_to_string(w, ' '), '') FROM k WHERE len(w) < {least_words} AND length(array_to_string(w, ' ')) >= {least_characters}),
p AS (SELECT f, c, u, unnest(range(1, len(u) + 1)) AS p FROM u),
v AS (SELECT f, c, p, list_concat(u[1:p - 1], u[p + 1:]) AS v FROM p),
bad AS (SELECT f FROM (SELECT f, min(f) OVER (PARTITION BY c, v, p) AS m FROM v) WHERE m < f
  UNION SELECT greatest(v.f, u.f) FROM v JOIN u ON v.v = u.u AND v.c = u.c),
r AS (SELECT w.pos AS pos FROM w JOIN k ON w.w = k.w LEFT JOIN bad ON k.f = bad.f WHERE w.pos <> k.f OR bad.f IS NOT NULL),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.pos IS NULL), '') AS text, count(r.pos) AS n FROM w LEFT JOIN r ON w.pos = r.pos GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN t.n > 0 THEN t.text ELSE d.text END AS text, coalesce(t.n, 0)::INT AS n_removed FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""
