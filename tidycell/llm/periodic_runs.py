"""Periodic runs of words, found by dyadic square catchers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
``TIMES * q`` and ``LEAST`` words long, that no neighbouring word extends with that period.

An online detector appends words one by one.  Whenever a block of 2**k words is completed it sets up
a catcher for that block: while the next 2**k words are appended, the suffix of 2**k words is compared with the
block, and equality at distance q means that a square of period q (2**k <= q < 2**(k+1)) may start with the
block.  The square is confirmed by its second pair of halves, and squares of one period that overlap are one
run, whose ends are then found by comparing words.  Here all catchers of one size advance together over
the appended words, as arrays; sizes go up, which is the order in which an online detector reports.

Nothing is lost: a run of period q holds 3q words, so the first block of 2**k <= q words that starts in
it has the whole square of period q behind it.  A square inside a run of a smaller period is no new run
(its root is a power, by Fine and Wilf), and is left out, which keeps a text of one word from reporting all its periods.

A text of n words takes some n * log2(n / 3) comparisons of arrays, whatever it holds.  Texts are worked on in chunks
of bounded size and one by one above it, with about 60 bytes a word.  Words are compared by 64-bit digests.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; very long texts are read whole;
rows that repeat or share an id are judged one by one; an id of any type, also null, is passed on; an empty
table gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidycell.llm.words import Words, chunks, mix

LEAST = 24
TIMES = 3


def _strictly(size: int, salt: int) -> np.ndarray:
    """Values that equal no digest and no one another, but for chance of 64 bits."""
    return mix(np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _squares(h: np.ndarray, block: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that the catchers of one size report; ``h`` has the digests of
    ``block`` words from every position on."""
    whole = -(-len(h) // block) * block
    rows = np.concatenate([h, _strictly(whole - len(h), block)]).reshape(-1, block)
    k, j = np.nonzero(rows[1:] == rows[:-1, :1])
    start, period = k * block, block + j
    end = start + 2 * period
    fits = end <= n
    start, period, end = start[fits], period[fits], end[fits]
    same = h[start + period - block] == h[end - block]
    return start[same], period[same]


def _merged(start: np.ndarray, period: np.ndarray, block: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of squares joined with those of the same period in the next block."""
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > start[:-1] + block)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return zip(start[first].tolist(), (start[last] + 2 * period[last]).tolist(), period[first].tolist())


def _stretched(ids: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The ends of the run around a stretch that has the period."""
    step = 32
    while start:
        low = max(0, start - step)
        odd = np.flatnonzero(ids[low:start] != ids[low + period : start + period])
        if len(odd):
            start = low + int(odd[-1]) + 1
            break
        start, step = low, step * 2
    step = 32
    while end < len(ids):
        high = min(len(ids), end + step)
        odd = np.flatnonzero(ids[end:high] != ids[end - period : high - period])
        if len(odd):
            end += int(odd[0])
            break
        end, step = high, step * 2
    return start, end


def _everywhere(ids: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches of a period of at least that length."""
    edge = np.flatnonzero(np.diff((ids[period:] == ids[:-period]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2] + period
    long = end - start >= least
    return start[long], end[long]


def runs(ids: np.ndarray, most: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, end, period) of every run of a sequence with periods up to ``most``, sorted; ``times`` is 3 or more."""
    if times < 3:
        raise ValueError("catchers see every run that holds its period three times")
    n, h, block = len(ids), ids, 1
    covered = np.zeros(n, np.int64)  # the farthest end of the runs that started so far
    found: list[tuple[int, int, int]] = []
    while block <= most:
        start, period = _squares(h, block, n)
        news = (period <= most) & (covered[start] < start + 2 * period)
        start, period = start[news], period[news]
        now: set[tuple[int, int, int]] = set()
        if len(start) and block < 16:
            for q in np.unique(period).tolist():
                at, end = _everywhere(ids, q, max(least, times * q))
                news = covered[at] < end  # else a run of a smaller period
                now.update((a, b, q) for a, b in zip(at[news].tolist(), end[news].tolist()))
                for a, b in zip(at[news].tolist(), end[news].tolist()):
                    covered[a] = max(covered[a], b)
                covered = np.maximum.accumulate(covered)
        elif len(start):
            for a, b, q in _merged(start, period, block):
                a, b = _stretched(ids, a, b, q)
                if b - a >= max(least, times * q):
                    now.add((a, b, q))
            for a, b, _ in now:
                covered[a] = max(covered[a], b)
            covered = np.maximum.accumulate(covered)
        found += now
        if len(h) <= block:
            break
        h = mix(h[:-block] * np.uint64(0xA24BAED4963EE407 | 1)) + h[block:]
        block *= 2
    return np.array(sorted((a, q, b) for a, b, q in found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _of_texts(words: Words) -> list[np.ndarray]:
    """The runs of every text; texts of like size share their arrays, each closed by a value found nowhere else."""
    counts = words.counts()
    out = [np.zeros((0, 3), np.int64)] * len(counts)
    kinds = np.where(counts >= LEAST, np.frexp(counts // TIMES)[1], 0)
    for kind in np.unique(kinds[kinds > 0]).tolist():
        rows = np.flatnonzero(kinds == kind)
        starts = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(counts[rows] + 1, out=starts[1:])
        ids = _strictly(int(starts[-1]), 0x5DEECE66D)
        for at, row in zip(starts.tolist(), rows.tolist()):
            ids[at : at + counts[row]] = words.digests[words.bounds[row] : words.bounds[row + 1]]
        got = runs(ids, int(counts[rows].max()) // TIMES)
        text = np.searchsorted(starts, got[:, 0], "right") - 1
        for i in np.unique(text).tolist():
            out[rows[i]] = got[text == i] - np.array([starts[i], starts[i], 0])
    return out


def strongest(found: np.ndarray) -> tuple[int, int, int]:
    """(start, end, period) with the greatest length by period, compared exactly; of equals the first by start, then period."""
    best = found[0].tolist()
    for a, b, q in found[1:].tolist():
        if (b - a) * best[2] > (best[1] - best[0]) * q:
            best = [a, b, q]
    return tuple(best)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in chunks(texts):
            words = Words(texts[i:j])
            found, best, kept = [], [], []
            for text, got in zip(texts[i:j], _of_texts(words)):
                parts = (text or "").encode("utf-8", "replace").split()
                if len(got):
                    gone = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(gone, got[:, 0] + got[:, 2], 1)
                    np.add.at(gone, got[:, 1], -1)
                    parts = [parts[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    a, b, q = strongest(got)
                    best.append({"start": a, "length": b - a, "period": q})
                else:
                    best.append(None)
                found.append([{"start": a, "length": b - a, "period": q} for a, b, q in got.tolist()])
                kept.append(b" ".join(parts).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(words.counts(), pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed"])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed): every document with its runs by start and period, the run of greatest
    length by period (null without runs), and its words without those that a run holds after its first period."""
    run = "struct<start: long, length: long, period: long>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
        _rows, f"doc_id {kind}, n_words long, runs array<{run}>, strongest {run}, collapsed string")
