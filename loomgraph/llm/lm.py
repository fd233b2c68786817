"""Operator 5, language-model scoring by a weighted backoff automaton of character n-grams.

Counts are taken over every text of the corpus and smoothed after Witten and Bell. A state of the automaton is a
context; an arc reads a character, has its log-probability, and leads to the longest context that is known then;
a failure arc shortens the context at the price of its backoff weight. A text is scored in one pass that carries a state.

The model may be larger than any worker's memory, so no worker loads it whole. Texts are read in blocks of some
megabytes; a block asks the model's table for the arcs that its own n-grams take, and for failure arcs where there are none,
builds the automaton of these, and its texts are traversed with it. That is the same at every size of the model."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import give_back, slices, small_batches, type_name
from .shared import folder, written

ORDER, LEAST_COUNT = 5, 1
#: Stands before a text begins; a text that has this non-character has U+FFFD in its place.
PAD = "\U0010ffff"
#: Bytes of text in a block: whole texts until there are so many; and of texts that are traversed side by side.
BLOCK, SIDE_BY_SIDE = 8 << 20, 4 << 20
#: Code points: what an unseen character's share is spread over.
CODES = 0x110000
LANES = 8192
#: Blocks of a task.
TASK = 32


def _clean(text: str) -> str:
    if not text.isascii():
        text = text.encode("utf-8", "replace").decode().replace(PAD, "�")
    return text


def _grams(flat: np.ndarray, order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct windows of `order` code points, the number of each, and which each position has."""
    seen = np.zeros(CODES, bool)
    seen[flat] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    count = len(flat) - order + 1
    if bits * order <= 62:
        dense = np.zeros(CODES, np.int64)
        dense[alphabet] = np.arange(len(alphabet))
        small = dense[flat]
        key = np.zeros(count, np.int64)
        for j in range(order):
            key = key << bits | small[j : j + count]
        which, distinct = pd.factorize(key)
        shifts = np.arange(order - 1, -1, -1) * bits
        windows = alphabet[(distinct[:, None] >> shifts) & ((1 << bits) - 1)]
    else:
        windows, which = np.unique(np.lib.stride_tricks.sliding_window_view(flat, order), axis=0, return_inverse=True)
        which = which.reshape(-1)
    joined = np.ascontiguousarray(windows, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + order] for i in range(0, len(joined), order)], which, windows


def blocked(df: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts cut into blocks, written to the shared folder: a row a text (block, id, t), and a row for each different
    window of `order` characters of a block (block, g, n) with its number; a text has `order` - 1 pads before it."""
    id_type = type_name(df, id_col)
    names = ["block", "id", "t", "g", "n"]

    def described(block: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), batch.column(0), batch.column(1), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())], names=names)
            parts += [PAD * (order - 1) + _clean(t) for t in batch.column(1).to_pylist() if t]
        flat = np.frombuffer(("".join(parts) + PAD).encode("utf-32-le"), "<u4")
        if len(flat) >= order and parts:
            grams, which, windows = _grams(flat, order)
            counts = np.bincount(which, minlength=len(grams))
            real = np.flatnonzero(windows[:, -1] != ord(PAD))
            rows = len(real)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), pa.nulls(rows, batch.column(0).type), pa.nulls(rows, batch.column(1).type), pa.array([grams[i] for i in real], pa.string()), pa.array(counts[real])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, 4000, size=BLOCK):
            waiting.append(batch)
            size += batch.column(1).nbytes
            if size >= BLOCK:
                yield from described(block, waiting)
                block, waiting, size = block + 1, [], 0
        if waiting:
            yield from described(block, waiting)
        give_back()

    return written(small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"block bigint, id {id_type}, t string, g string, n bigint"))


def train(df: DataFrame, order: int = ORDER, least_count: int = LEAST_COUNT, text_col: str = "text") -> str:
    """Build a model of the whole corpus; the folder that it is written to, below the shared one.

    Rows are (k, g, lp, bow): an n-gram of k characters, the log-probability of its last one, and its backoff weight as
    a context. n-grams of two characters and more that come up fewer than `least_count` times are left out; with the
    default of 1 none are."""
    return _train(blocked(df, order, text_col, text_col), order, least_count)


def _train(blocks: DataFrame, order: int, least_count: int) -> str:
    spark, path = blocks.sparkSession, f"{folder(blocks.sparkSession)}/lm-{uuid.uuid4().hex}"
    counted = written(blocks.where("g IS NOT NULL").groupBy("g").agg(F.sum("n").alias("n")))
    kept = [counted.select(F.expr(f"right(g, {k})").alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n")) for k in range(1, order)] + [counted]
    kept = [kept[0], *(x.where(F.col("n") >= least_count) if least_count > 1 else x for x in kept[1:])]
    contexts = [x.groupBy(F.expr(f"left(g, {k - 1})").alias("h")).agg(F.sum("n").alias("c"), F.count("*").alias("t")) for k, x in enumerate(kept, 1)]
    weight = F.log(F.col("t") / (F.col("c") + F.col("t")))
    for k, x in enumerate(kept, 1):
        x = x.withColumn("h", F.expr(f"left(g, {k - 1})")).withColumn("s", F.expr(f"substr(g, 2)"))
        x = x.join(contexts[k - 1], "h")
        if k == 1:
            x = x.withColumn("lp", F.log((F.col("n") + F.col("t") / CODES) / (F.col("c") + F.col("t"))))
            root = contexts[0].select(F.lit(0).alias("k"), F.lit("").alias("g"), F.lit(None).cast("double").alias("lp"), weight.alias("bow"))
            root.write.parquet(f"{path}/k=0")
        else:
            shorter = spark.read.parquet(f"{path}/k={k - 1}").where("lp IS NOT NULL").select(F.col("g").alias("s"), F.exp("lp").alias("q"))
            x = x.join(shorter, "s").withColumn("lp", F.log((F.col("n") + F.col("t") * F.col("q")) / (F.col("c") + F.col("t"))))
        x = x.select("g", "lp")
        if k < order:
            x = x.join(contexts[k].select(F.col("h").alias("g"), weight.alias("bow")), "g", "full")
        else:
            x = x.withColumn("bow", F.lit(None).cast("double"))
        x.select(F.lit(k).alias("k"), "g", "lp", F.coalesce("bow", F.lit(0.0)).alias("bow")).write.parquet(f"{path}/k={k}")
    return path


def _numbered(windows: np.ndarray, symbols: np.ndarray, width: int, tables: list[np.ndarray]) -> np.ndarray:
    """A number for each window, the same for equal ones, whatever the size of the alphabet. `tables`, empty at first, lets
    the same windows be numbered again."""
    number, bits, fill, at = np.zeros(len(windows), np.int64), int(width).bit_length(), not tables, 0
    for j in range(windows.shape[1]):
        if j and bits * (j + 1) > 62:
            if fill:
                tables.append(np.unique(number))
            number, at = np.searchsorted(tables[at], number) * width + symbols[windows[:, j]], at + 1
        else:
            number = number << bits | symbols[windows[:, j]]
    return number


class Automaton:
    """The arrays of states and arcs that a block's texts can reach. State 0 is the empty context.

    `arcs` are (windows, log-probabilities) by length, of which the longest are all windows of the block, NaN where
    the model has none; `weights` are (contexts, backoff weights) by length; `unseen` is the log-probability of a character
    that the model doesn't know."""

    def __init__(self, order: int, arcs: dict[int, tuple[np.ndarray, np.ndarray]], weights: dict[int, tuple[np.ndarray, np.ndarray]], unseen: float):
        self.order, self.unseen = order, unseen
        longest = arcs[order][0]
        alphabet = np.unique(longest)
        self.symbols = np.full(CODES, len(alphabet), np.int32)
        self.symbols[alphabet] = np.arange(len(alphabet))
        self.width = len(alphabet) + 1
        none = lambda k: np.zeros((0, k), np.uint32)
        # the contexts before and after each window are states, and so are their suffixes, down to the empty one
        states, place, fail, backoff = np.concatenate([longest[:, :-1], longest[:, 1:], np.full((1, order - 1), ord(PAD), np.uint32)]), {}, {}, {}
        for k in range(order - 1, 0, -1):
            ends = arcs[k][0] if k in arcs else none(k)
            begins = arcs[k + 1][0][:, :-1] if k + 1 in arcs and k + 1 < order else none(k)
            parts = [states, ends, begins, weights[k][0] if k in weights else none(k)]
            windows = np.concatenate(parts)
            tables: list[np.ndarray] = []
            number, distinct = pd.factorize(_numbered(windows, self.symbols, self.width, tables))
            if k == order - 1:
                self.tables, at = tables, np.argsort(distinct)
                self.contexts, self.context_states = distinct[at], at
            place[k] = np.split(number, np.cumsum([len(x) for x in parts])[:-1])
            fail[k + 1] = place[k][0]  # of the states one longer, whose suffixes these are
            backoff[k] = np.zeros(len(distinct))
            if k in weights:
                backoff[k][place[k][3]] = weights[k][1]
            one = np.zeros(len(distinct), np.int64)
            one[number] = np.arange(len(number))
            states = windows[one][:, 1:]
        offset = {k: 1 + sum(len(backoff[j]) for j in range(1, k)) for k in range(1, order)} | {0: 0}
        self.fail = np.concatenate([np.zeros(1, np.int32), *((fail[k] + offset[k - 1] if k > 1 else np.zeros(len(backoff[1]), np.int64)) for k in range(1, order))]).astype(np.int32)
        self.backoff = np.concatenate([np.zeros(1), *(backoff[k] for k in range(1, order))])
        keys, scores, targets = [], [], []
        for k, (windows, lp) in arcs.items():
            source = target = np.zeros(len(windows), np.int64)
            if k == order and k > 1:
                source, target = (place[k - 1][0][: 2 * len(windows)] + offset[k - 1]).reshape(2, -1)
            elif k < order:
                source, target = place[k - 1][2] + offset[k - 1] if k > 1 else source, place[k][1] + offset[k]
            has = ~np.isnan(lp)
            keys.append((source * self.width + self.symbols[windows[:, -1]])[has]), scores.append(lp[has]), targets.append(target[has].astype(np.int32))
        if order > 1:
            self.context_states = self.context_states + offset[order - 1]
        self.start = int(place[order - 1][0][-1] + offset[order - 1]) if order > 1 else 0
        self._index(np.concatenate(keys), np.concatenate(scores), np.concatenate(targets))

    def _index(self, keys: np.ndarray, scores: np.ndarray, targets: np.ndarray) -> None:
        """Open addressing: an arc stands in the first free place from its hash on."""
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.scores, self.targets = np.full(size, -1, np.int64), np.zeros(size), np.zeros(size, np.int32)
        left, at = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            self.scores[at[done]], self.targets[at[done]] = scores[left[done]], targets[left[done]]
            left, at = left[~done], (at[~done] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) & self.mask.view(np.uint64)).view(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each arc, -1 for arcs that don't exist."""
        at = self._hash(keys)
        have = self.keys[at]
        odd = np.flatnonzero((have != keys) & (have != -1))
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            have[odd] = self.keys[at[odd]]
            odd = odd[(have[odd] != keys[odd]) & (have[odd] != -1)]
        return np.where(have == keys, at, -1)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one character in each lane: its log-probability, and the state after it."""
        at = self._find(state.astype(np.int64) * self.width + symbol)
        score, new = self.scores[at], self.targets[at]
        left = np.flatnonzero(at < 0)
        if len(left):
            score[left], current = 0, state[left]
            while len(left):
                root = current == 0
                if root.any():
                    score[left[root]] += self.unseen
                    new[left[root]] = 0
                    left, current = left[~root], current[~root]
                score[left] += self.backoff[current]
                current = self.fail[current]
                at = self._find(current.astype(np.int64) * self.width + symbol[left])
                hit = at >= 0
                score[left[hit]] += self.scores[at[hit]]
                new[left[hit]] = self.targets[at[hit]]
                left, current = left[~hit], current[~hit]
        return score, new

    def _states_at(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The state before each of these places: the characters before it, and pads before the text's beginning."""
        if self.order == 1:
            return np.zeros(len(starts), np.int32)
        places = starts[:, None] + np.arange(1 - self.order, 0)
        before = np.where((places >= 0) & (places < len(flat)), flat[np.clip(places, 0, len(flat) - 1)], ord(PAD)).astype(np.uint32)
        before[np.logical_or.accumulate((before == ord(PAD))[:, ::-1], axis=1)[:, ::-1]] = ord(PAD)
        at = np.searchsorted(self.contexts, _numbered(before, self.symbols, self.width, self.tables))
        return self.context_states[np.minimum(at, len(self.contexts) - 1)].astype(np.int32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text.

        The texts stand one after the other behind pads, and the whole is cut into lanes of equal length that
        are read side by side, each from the state that the characters before it lead to."""
        flat = np.frombuffer("".join(PAD + t for t in texts).encode("utf-32-le"), "<u4")
        if not len(flat):
            return np.zeros(len(texts))
        lanes = min(LANES, -(-len(flat) // 64))
        length = -(-len(flat) // lanes)
        symbol = np.full(lanes * length, self.width, np.int32)
        symbol[: len(flat)] = np.where(flat == ord(PAD), self.width, self.symbols[flat])
        starts = np.arange(lanes) * length
        state, out = self._states_at(flat, starts), np.zeros((length, lanes))
        for t in range(length):
            now = symbol[starts + t]
            pad = now == self.width
            score, state = self._step(state, np.where(pad, self.width - 1, now))
            state[pad], score[pad] = self.start, 0
            out[t] = score
        each = out.T.ravel()[: len(flat)]
        firsts = np.flatnonzero(flat == ord(PAD))
        return np.add.reduceat(each, firsts)


def _windows(grams: list[str], k: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, k)


def _score(blocks: DataFrame, path: str, order: int, id_col: str) -> DataFrame:
    spark, id_type = blocks.sparkSession, type_name(blocks, "id")
    model = lambda k: spark.read.parquet(f"{path}/k={k}")
    root = model(0).first()
    unseen = (root.bow if root and root.bow is not None else 0.0) - float(np.log(CODES))
    asked, rows = blocks.where("g IS NOT NULL").select("block", "g"), blocks.where("g IS NULL").select("block", F.lit(2).alias("kind"), F.lit(None).cast("string").alias("g"), F.lit(None).cast("double").alias("value"), "id", "t")
    for k in range(order, 0, -1):
        # arcs of the windows of a block; where the model has none, the context's failure arc, and the shorter window's arc
        found = written(asked.join(model(k).where("lp IS NOT NULL").select("g", "lp"), "g", "left"))
        arcs = found if k == order else found.where("lp IS NOT NULL")
        rows = rows.unionByName(arcs.select("block", F.lit(1).alias("kind"), "g", F.col("lp").alias("value")), allowMissingColumns=True)
        missing = found.where("lp IS NULL")
        if k == 1 or missing.isEmpty():
            break
        contexts = missing.select("block", F.expr(f"left(g, {k - 1})").alias("g")).distinct().join(model(k - 1).select("g", "bow"), "g")
        rows = rows.unionByName(contexts.select("block", F.lit(0).alias("kind"), "g", F.col("bow").alias("value")), allowMissingColumns=True)
        asked = missing.select("block", F.expr(f"right(g, {k - 1})").alias("g")).distinct()

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, model, parts = None, None, {}

        def built() -> Automaton | None:
            made: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {0: {}, 1: {}}
            for (kind, k), lists in parts.items():
                made[kind][k] = _windows([g for x, _ in lists for g in x], k), np.concatenate([v for _, v in lists])
            return Automaton(order, made[1], made[0], unseen) if order in made[1] else None

        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block, prepend=-1, append=-1) != 0) | (np.diff(kind, prepend=-1, append=-1) != 0))
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if block[a] != current:
                    current, model, parts = block[a], None, {}
                if kind[a] < 2:
                    grams, values = part.column(2).to_pylist(), part.column(3).to_numpy(zero_copy_only=False).astype(float)
                    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
                    for k in np.unique(sizes).tolist():
                        own = np.flatnonzero(sizes == k)
                        parts.setdefault((int(kind[a]), k), []).append(([grams[i] for i in own], values[own]))
                    continue
                if parts:
                    model, parts = built(), {}
                for some in slices(iter([part]), 4000, column=5, size=SIDE_BY_SIDE):
                    texts = [None if t is None else _clean(t) for t in some.column(5).to_pylist()]
                    null = np.array([t is None for t in texts], bool)
                    scores = model.score([t or "" for t in texts]) if model else np.zeros(len(texts))
                    yield pa.RecordBatch.from_arrays([some.column(4), pa.array([None if t is None else len(t) for t in texts], pa.int32()), pa.array(scores, mask=null)], names=["id", "n_characters", "lp"])
        give_back()

    # a task gets a bounded number of blocks, whatever the size of the table
    number = blocks.where("g IS NULL").agg(F.count_distinct("block")).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), number // TASK)
    placed = rows.repartition(tasks, "block").sortWithinPartitions("block", "kind")
    scored = placed.mapInArrow(traverse, f"id {id_type}, n_characters int, lp double")
    n, lp = F.col("n_characters"), F.col("lp")
    return scored.select(F.col("id").alias(id_col), "n_characters", F.round(lp, 3).alias("log_probability"), F.when(n > 0, F.round(F.exp(-lp / n), 4)).alias("perplexity"))


def score_with(df: DataFrame, path: str, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As score_documents, under the model that train() wrote to `path`, of these or other texts."""
    return _score(blocked(df, order, id_col, text_col), path, order, id_col)


def score_documents(df: DataFrame, order: int = ORDER, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id, n_characters, log_probability, perplexity) under a model of all the documents.

    log_probability is the natural logarithm, to three digits; perplexity is by character, to four. n-grams of two
    characters and more that come up fewer than `least_count` times are left out of the model; by default none are.

    An empty text has log-probability 0 and no perplexity; a null text gives nulls and adds nothing to the
    counts. Copies are counted as often as they are there. Texts are counted and scored whole, and may have any number of
    different characters. Rows that repeat an id have a row each; an empty table gives none."""
    blocks = blocked(df, order, id_col, text_col)
    return _score(blocks, _train(blocks, order, least_count), order, id_col)


def oracle(order: int = ORDER, least_count: int = LEAST_COUNT) -> str:
    last = order - 1
    pad = f"chr({ord(PAD)})"
    lags = ", ".join(f"coalesce(lag(c, {j}) OVER w, {pad}) AS c{j}" for j in range(1, order))
    sql = f"""WITH u AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM documents WHERE length(text) > 0),
x AS (SELECT doc_id, c, {lags} FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT doc_id, {' || '.join(f'c{j}' for j in range(last, 0, -1))} || c AS g FROM x),
n{order} AS (SELECT g, count(*) AS n FROM q GROUP BY g)"""
    for k in range(1, order):
        sql += f",\nn{k} AS (SELECT right(g, {k}) AS g, sum(n) AS n FROM n{order} GROUP BY 1)"
    for k in range(1, order + 1):
        kept = f"SELECT * FROM n{k}" + (f" WHERE n >= {least_count}" if k > 1 else "")
        sql += f",\nk{k} AS ({kept}),\nh{k} AS (SELECT left(g, {k - 1}) AS h, sum(n) AS c, count(*) AS t FROM k{k} GROUP BY 1)"
        q = f"1.0 / {CODES}" if k == 1 else "s.p"
        join = "" if k == 1 else f" JOIN p{k - 1} s ON s.g = substr(k{k}.g, 2)"
        sql += f",\np{k} AS (SELECT k{k}.g, (n + t * {q}) / (c + t)::DOUBLE AS p FROM k{k} JOIN h{k} ON h = left(k{k}.g, {k - 1}){join})"
    score = f"h1.t / (h1.c + h1.t)::DOUBLE / {CODES}"
    for k in range(1, order + 1):
        score = f"coalesce(p{k}.p, {score if k == 1 else f'coalesce(h{k}.t / (h{k}.c + h{k}.t)::DOUBLE, 1.0) * {score}'})"
    joins = "".join(f" LEFT JOIN p{k} ON p{k}.g = right(n{order}.g, {k}) LEFT JOIN h{k} ON h{k}.h = left(right(n{order}.g, {k}), {k - 1})" for k in range(1, order + 1))
    return sql + f""",
l AS (SELECT n{order}.g, ln({score}) AS lp FROM n{order}{joins}),
d AS (SELECT doc_id, sum(lp) AS lp FROM q JOIN l USING (g) GROUP BY doc_id)
SELECT a.doc_id, length(a.text)::INT AS n_characters, CASE WHEN a.text IS NOT NULL THEN round(coalesce(lp, 0.0), 3) END AS log_probability,
  CASE WHEN length(a.text) > 0 THEN round(exp(-lp / length(a.text)), 4) END AS perplexity FROM documents a LEFT JOIN d ON a.doc_id = d.doc_id"""
