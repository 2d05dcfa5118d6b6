"""Which page of its document a text shares most shingles with, for whole documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts, letters, pairs of a question and a page, and shared shingles that are handled together; a single document may hold more.
TEXTS, LETTERS, CELLS = 100_000, 1 << 19, 1 << 21
#: A shingle is three numbers of 15 bits, behind them stands the text that holds it.
BITS, OWNER = 15, 18


@lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    """For each code point the number of the letter or digit, 0 for all others."""
    table = np.zeros(0x110000, np.uint16)
    kept = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(ord("一"), ord("龥") + 1)]
    table[kept] = np.arange(1, len(kept) + 1)
    return table


def _held(texts: list[str | None]) -> np.ndarray:
    """The different shingles of the texts in order, each with the number of its text in the lowest bits."""
    texts = [t or "" for t in texts]
    found = _numbers()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])[found != 0]
    n = found[found != 0].astype(np.int64)
    size = np.bincount(owner, minlength=len(texts))
    code = (n[:-2] << 2 * BITS | n[1:-1] << BITS | n[2:])[owner[:-2] == owner[2:]] if len(n) > 2 else n[:0]
    own = owner[:-2][owner[:-2] == owner[2:]] if len(n) > 2 else owner[:0]
    first = np.cumsum(size) - size
    one, two = np.flatnonzero(size == 1), np.flatnonzero(size == 2)  # the whole of a short text
    code = np.concatenate([code, n[first[one]], n[first[two]] << BITS | n[first[two] + 1]])
    held = np.sort(code << OWNER | np.concatenate([own, one, two]))
    return held[np.diff(held, prepend=-1) != 0]


def _best(first: np.ndarray, last: np.ndarray, held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each question the number of its page among those from ``first`` to before ``last``, or -1 when it shares nothing."""
    width = last - first
    best = np.full(len(first), -1, np.int64)
    owner = asked & ((1 << OWNER) - 1)
    code = asked - owner
    lo, hi = np.searchsorted(held, code + first[owner]), np.searchsorted(held, code + last[owner])
    met = hi > lo
    owner, lo, n = owner[met], lo[met], (hi - lo)[met]
    order = np.argsort(owner, kind="stable")
    owner, lo, n = owner[order], lo[order], n[order]
    load = np.maximum(width, np.bincount(owner, n, len(first)).astype(np.int64))
    starts = np.searchsorted(owner, np.arange(len(first) + 1))
    done, at = np.cumsum(load), 0
    while at < len(first):  # as many questions as fill the cells, one at least
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CELLS, "right")))
        cell = np.cumsum(width[at:end]) - width[at:end]
        some = slice(starts[at], starts[end])
        many = n[some]
        if len(many):
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            page = held[np.repeat(lo[some], many) + inside] & ((1 << OWNER) - 1)
            k = np.repeat(owner[some], many)
            counts = np.bincount(cell[k - at] + page - first[k], minlength=int(width[at:end].sum()))
            local = np.arange(len(counts)) - np.repeat(cell, width[at:end])
            rows = np.flatnonzero(width[at:end])
            top = np.maximum.reduceat(counts << OWNER | ((1 << OWNER) - 1 - local), cell[rows])
            best[at + rows] = np.where(top >> OWNER > 0, first[at + rows] + (1 << OWNER) - 1 - (top & ((1 << OWNER) - 1)), -1)
        at = end
    return best


def _answered(t: pa.Table) -> pa.RecordBatch:
    """(doc_id, q, page_index) of whole documents, whose pages stand in order before their questions."""
    asks = t.column("asks").to_numpy()
    doc = _documents(t.column("doc_id"))
    p, q = np.flatnonzero(~asks), np.flatnonzero(asks)
    index, texts = t.column("page").take(pa.array(p)).to_numpy().astype(np.int64), t.column("t").to_pylist()
    if not len(p) or not len(q):
        number = np.zeros(len(q), np.int64)
    else:
        new = np.diff(doc[p], prepend=-1).astype(bool) | np.concatenate([[True], np.diff(index) != 0])
        pages = np.cumsum(new) - 1  # texts of the same page count as one
        held = _held([texts[k] for k in p])
        held = np.sort(held - (held & ((1 << OWNER) - 1)) + pages[held & ((1 << OWNER) - 1)])
        held = held[np.diff(held, prepend=-1) != 0]
        of = doc[p][new]
        first, last = np.searchsorted(of, doc[q]), np.searchsorted(of, doc[q], "right")
        best = _best(first, last, held, _held([texts[k] for k in q]))
        number = np.where(best >= 0, index[new][best], 0)
    kept = [pa.concat_arrays(t.column(c).chunks).take(pa.array(q)) for c in ("doc_id", "q")]
    return pa.record_batch([*kept, pa.array(number.astype(np.int32))], ["doc_id", "q", "page_index"])


def _documents(c: pa.ChunkedArray) -> np.ndarray:
    """Numbers of the documents that stand behind one another."""
    own = pa.concat_arrays(c.chunks)
    other = pc.not_equal(own.slice(1), own.slice(0, len(own) - 1))
    return np.concatenate([[0], np.cumsum(other.to_numpy(zero_copy_only=False))])


def best_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, q, page_index) of rows (doc_id, page, q, asks, t): documents one behind another, their pages in order and then their questions."""
    waiting, rows, letters = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        waiting, rows, letters = [*waiting, b], rows + b.num_rows, letters + (pc.sum(pc.utf8_length(b.column("t"))).as_py() or 0)
        if rows < TEXTS and letters < LETTERS:
            continue
        t = pa.Table.from_batches(waiting)
        doc = _documents(t.column("doc_id"))
        whole = int(np.searchsorted(doc, doc[-1]))  # the last may go on
        if whole:
            yield _answered(t.slice(0, whole))
            waiting = t.slice(whole).combine_chunks().to_batches()
            rows, letters = t.num_rows - whole, pc.sum(pc.utf8_length(t.column("t").slice(whole))).as_py() or 0
    if waiting:
        yield _answered(pa.Table.from_batches(waiting))
