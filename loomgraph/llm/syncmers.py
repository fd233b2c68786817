"""Operator 4, document fingerprints: closed syncmers over code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import codes, lists, per_slice, small_batches, type_name

K, S = 40, 9
#: Primes and multipliers of the hashes; all sums stay below 2^62, so SQL and numpy agree to the bit.
P1, P2, MIX = 2147483647, 2147483629, 1103515245


def coefficients(n: int, seed: int) -> list[int]:
    """n fixed odd numbers below 2^28."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 36 | 1)
    return out


def window_sums(flat: np.ndarray, weights: list[int]) -> np.ndarray:
    """For each position, the weighted sum of the code points that follow."""
    n = len(flat) - len(weights) + 1
    total = np.zeros(n, np.int64)
    for j, weight in enumerate(weights):
        total += flat[j : j + n] * weight
    return total


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done, best = 1, values
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[: len(best) - step], best[step:])
        done += step
    return best


def syncmers(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many anchors each text has, their positions in the text, and their fingerprints."""
    flat, sizes = codes(texts)
    flat, none = flat.astype(np.int64), np.zeros(0, np.int64)
    if len(flat) < k:
        return np.zeros(len(texts), np.int64), none, none
    keys = (window_sums(flat, coefficients(s, 1)) % P2 * MIX + 12345) & 0x7FFFFFFF
    inner = k - s + 1
    least = sliding_min(keys, inner)
    starts = np.cumsum(sizes) - sizes
    room = np.repeat(starts + sizes - k, sizes)[: len(least)]  # the last start that its text has room for
    chosen = np.flatnonzero(((keys[: len(least)] == least) | (keys[inner - 1 :] == least)) & (np.arange(len(least)) <= room))
    high, low = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
    for j, (a, b) in enumerate(zip(coefficients(k, 2), coefficients(k, 3))):
        code = flat[chosen + j]
        high += code * a
        low += code * b
    text = np.searchsorted(starts + sizes, chosen, side="right")
    return np.bincount(text, minlength=len(texts)), chosen - starts[text], (high % P1 << 31) + low % P2


def fingerprints(df: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id, n_anchors, positions, fingerprints).

    A k-mer of characters is an anchor if the smallest hash of its k - s + 1 inner s-mers is that of its first
    or its last one (ties count: an edge that equals the smallest is enough). Whether a k-mer is chosen
    depends on the k-mer alone, so a shared passage has the same anchors in every document, at positions
    that differ by a constant. Positions count characters from 0, in rising order; a fingerprint has 62 bits.

    Texts of fewer than k characters, empty ones too, have no anchors; a null text gives nulls. Long texts
    are read whole. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        null = np.array([t is None for t in texts], bool)
        counts, positions, hashes = syncmers([t or "" for t in texts], k, s)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts.astype(np.int32), mask=null), lists(positions.astype(np.int32), counts, null), lists(hashes, counts, null)],
            names=[id_col, "n_anchors", "positions", "fingerprints"],
        )

    if not 0 < s <= k:
        raise ValueError("s must lie between 1 and k")
    schema = f"`{id_col}` {type_name(df, id_col)}, n_anchors int, positions array<int>, fingerprints array<bigint>"
    return small_batches(df).select(id_col, text_col).mapInArrow(per_slice(run, 500), schema)


def oracle(k: int = K, s: int = S) -> str:
    inner = k - s
    leads = " + ".join(f"lead(c, {j}) OVER w * {weight}" if j else f"c * {weight}" for j, weight in enumerate(coefficients(s, 1)))
    high, low = (" + ".join(f"l[i + {j + 1}]::BIGINT * {weight}" for j, weight in enumerate(coefficients(k, seed))) for seed in (2, 3))
    return f"""
WITH d AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)) AS l, length(text) AS n FROM documents),
u AS (SELECT doc_id, n, unnest(l)::BIGINT AS c, unnest(range(n)) AS i FROM d WHERE n >= {k}),
h AS (SELECT doc_id, n, i, (({leads}) % {P2} * {MIX} + 12345) % 2147483648 AS h FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, n, i, h, lead(h, {inner}) OVER (PARTITION BY doc_id ORDER BY i) AS e,
  min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {inner} FOLLOWING) AS m FROM h),
a AS (SELECT doc_id, i FROM m WHERE i + {k} <= n AND (h = m OR e = m)),
f AS (SELECT doc_id, i, (({high}) % {P1}) * 2147483648 + (({low}) % {P2}) AS f FROM a JOIN d USING (doc_id)),
g AS (SELECT doc_id, count(*) AS n, list(i::INT ORDER BY i) AS p, list(f::BIGINT ORDER BY i) AS f FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0)::INT AS n_anchors, coalesce(p, []::INT[]) AS positions, coalesce(f, []::BIGINT[]) AS fingerprints
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
