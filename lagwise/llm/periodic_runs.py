"""Periodic runs of words by a sparse diagonal table that is filled as the words are read."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.words import mixed, slices

#: A run has this many words at least, and two periods.
LEAST = 12
#: Lags up to this one are looked up at every third word; from there on, at every ``lag / 4`` to ``lag / 2`` words.
_SHORT = 7
#: Cells of the table that are compared at once.
_CELLS = 1 << 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "n_words long"
)


def _matches(x: np.ndarray, h: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags ``low..high`` and places (multiples of ``step``) whose next ``step`` words stood there already, a lag before.

    ``h``: hash of ``step`` words by place. Sorted by lag, then place.
    """
    places = np.arange(0, len(x) - step + 1, step)
    lags, found = [], []
    width = high - low + 1
    earlier = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(high, h.dtype), h]), width)
    rows = max(1, _CELLS // width)
    for at in range(0, len(places), rows):
        p = places[at : at + rows]
        hit = earlier[p] == h[p][:, None]  # column c: the place high - c words before
        r, c = np.nonzero(hit)
        lag, place = high - c, p[r]
        inside = place >= lag
        lags.append(lag[inside])
        found.append(place[inside])
    lag, place = np.concatenate(lags), np.concatenate(found)
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _grown(h: dict[int, np.ndarray], at: np.ndarray, lag: np.ndarray, step: int, forward: bool) -> np.ndarray:
    """``at`` moved by up to ``step - 1`` matching words; ``h``: hashes of 1, 2, 4, ... words by place."""
    size = 1
    while 2 * size < step:
        size *= 2
    while size:
        hashes = h[size]
        a = at if forward else at - size
        ok = (a - lag >= 0) & (a + size <= len(h[1]))
        safe = np.where(ok, a, lag)
        ok &= hashes[np.minimum(safe, len(hashes) - 1)] == hashes[np.clip(safe - lag, 0, len(hashes) - 1)]
        at = np.where(ok, at + size if forward else a, at)
        size //= 2
    return at


def runs(x: np.ndarray, longest: int | None = None, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of all runs in the words ``x`` (one 64-bit value per distinct word), sorted.

    A diagonal of the table is a lag; a word that equals the word a lag before lengthens the match on that diagonal. A
    run of period q is a match of q words or more on diagonal q (and of ``least - q`` or more). The table is sparse: a
    match of that length holds a whole aligned block of ``step`` words, so only the blocks' earlier occurrences are
    looked up, at lags of the block's own octave. Blocks one after the other on one diagonal lengthen its active match;
    a match that ends is grown by the less than ``step`` words on either side, and if it is long enough it is a run.
    A run's multiples of its period give the same stretch; the least period stays. At most two cells per word and octave are
    compared, whatever the words are, so ten thousand copies of one word cost no more than prose.
    """
    n = len(x)
    longest = n if longest is None else longest
    if least <= 2 * _SHORT - 3:
        raise ValueError(f"runs of {2 * _SHORT - 2} words and more can be found")
    h, step = {1: x}, 1
    found = []

    def octave(h_step: np.ndarray, step: int, low: int, high: int) -> None:
        high = min(high, longest // 2, n - 1)
        if low > high or len(h_step) <= low:
            return
        lag, place = _matches(x, h_step, step, low, high)
        if not len(lag):
            return
        new = np.ones(len(lag), np.bool_)
        new[1:] = (np.diff(lag) != 0) | (np.diff(place) != step)
        begin = np.flatnonzero(new)
        lag, lo = lag[begin], place[begin]
        hi = place[np.append(begin[1:], len(new)) - 1] + step
        needed = np.maximum(lag, least - lag)
        maybe = hi - lo + 2 * (step - 1) >= needed
        lag, lo, hi, needed = lag[maybe], lo[maybe], hi[maybe], needed[maybe]
        lo = _grown(h, lo, lag, step, False)
        hi = _grown(h, hi, lag, step, True)
        long = hi - lo >= needed
        found.append(np.stack([lo[long] - lag[long], hi[long], lag[long]], axis=1))

    def doubled(a: np.ndarray, size: int) -> np.ndarray:
        return mixed(a[:-size] * _MULTIPLIER + a[size:]) if len(a) > size else a[:0]

    h[2] = doubled(x, 1)
    three = mixed(h[2][:-1] * _MULTIPLIER + x[2:]) if n > 2 else x[:0]
    octave(three, 3, 1, _SHORT)
    step = 2
    while 2 * step <= min(longest // 2, n - 1):
        h[2 * step] = doubled(h[step], step)
        step *= 2
        octave(h[step], step, 2 * step, 4 * step - 1)
    if not found:
        return np.empty((0, 3), np.int64)
    all_found = np.concatenate(found)
    all_found = all_found[np.lexsort((all_found[:, 2], all_found[:, 1], all_found[:, 0]))]
    first = np.ones(len(all_found), np.bool_)
    first[1:] = (np.diff(all_found[:, 0]) != 0) | (np.diff(all_found[:, 1]) != 0)
    start, end, period = all_found[first].T
    out = np.stack([start, end - start, period], axis=1)
    return out[np.lexsort((period, start))]


def covered(n: int, found: np.ndarray) -> np.ndarray:
    """For each of ``n`` words, whether some run contains it after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where a periodic tail is planted in one of ten documents: the original word to take at each place."""
    if not n:
        return None
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _of_batch(ids: list, texts: list[bytes | None], changed: Callable | None, least: int) -> list[tuple]:
    """All documents of a batch as one sequence of words, with a word of its own kind after each document."""
    number: dict[bytes, int] = {}
    split, numbers, first = [], [], [0]
    for i, t in zip(ids, texts):
        words = (t or b"").split()
        places = changed(i, len(words)) if changed else None
        if places is not None:
            words = [words[j] for j in places.tolist()]
        split.append(words)
        numbers += [number.setdefault(w, len(number)) for w in words]
        numbers.append(-1 - len(split))
        first.append(len(numbers))
    x = mixed(np.array(numbers, np.int64).view(np.uint64) * _MULTIPLIER + np.uint64(1))
    found = runs(x, max(map(len, split), default=0), least)
    of = np.searchsorted(first, found[:, 0], side="right") - 1
    edges = np.searchsorted(of, np.arange(len(split) + 1))
    out = []
    for k, words in enumerate(split):
        own = found[edges[k] : edges[k + 1]] - [first[k], 0, 0]
        if not len(own):
            out.append((0, None, None, None, None, _sha(b""), _sha(b" ".join(words)), len(words)))
            continue
        s, n, q = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
        said = "".join(f"{a},{b},{c}\n" for a, b, c in own.tolist())
        kept = np.flatnonzero(~covered(len(words), own)).tolist()
        out.append((len(own), s, n, q, 1000 * n // q, _sha(said.encode()), _sha(b" ".join([words[j] for j in kept])), len(words)))
    return out


def periodic_runs(docs: DataFrame, changed: Callable | None = None, least: int = LEAST) -> DataFrame:
    """``doc_id`` and ``SCHEMA``: the runs of each whole text of ``docs(doc_id, text)`` and the text without repeats.

    A run is a stretch of words with least period ``period``, of ``least`` words and two periods at least, that no
    neighbouring word extends. ``start, length, period, exponent_milli`` are those of the longest run (then the least
    start and period), null without one. The collapsed text has no word that some run holds after its first period.
    ``changed(doc_id, n)`` may give the places of the words to read instead of the text's own.

    Every row is judged for itself, also rows that repeat a doc_id or have none; null and empty texts have no words and
    the digests of empty text; an empty table gives an empty result; other columns are ignored. A task holds the texts
    of one batch of 2 MB, or one longer text, with eight bytes per word and doubling of the longest text.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = _of_batch(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), changed, least)
            cols = list(zip(*rows))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", *names])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(of, f"doc_id long, {SCHEMA}")
