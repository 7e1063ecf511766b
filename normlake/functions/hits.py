"""The entries of registers against what documents cite, in whole Arrow columns, for the Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Sections are 32-bit; a group's sections are set apart from the next group's by more than that.
_APART, _LEAST, _MOST = 1 << 33, -(1 << 31) - 1, 1 << 31


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """A number for each value, the null's among them, and the values."""
    d = pc.dictionary_encode(column, null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that no value of it is in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        doc, _ = _codes(b.column(0))
        cut = int(np.argmax(doc == doc[-1]))
        if held and (cut or held[-1].column(0)[-1].as_py() != b.column(0)[0].as_py()):
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield b.slice(0, cut)
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def judged(b: pa.RecordBatch, widest: int) -> pa.RecordBatch:
    """doc_id, law_key, kind, low, hit of the distinct entries among rows (doc_id, law_key, kind, low, high); rows with a high are spans that
    are cited; those that run backwards or over more than `widest` sections don't count. Spans of no known law, whose keys begin with a bracket, also count together for all laws."""
    (doc, _), (law, laws), (kind, kinds) = (_codes(b.column(k)) for k in range(3))
    entry = b.column(4).is_null().to_numpy(zero_copy_only=False)
    numbered = b.column(3).is_valid().to_numpy(zero_copy_only=False)
    low, high = (np.clip(pc.fill_null(b.column(k), 0).to_numpy(zero_copy_only=False), _LEAST, _MOST) for k in (3, 4))
    flag = lambda values, test: np.array([test(v) for v in values], bool)
    named = flag(laws, lambda v: v is not None)[law] & flag(kinds, lambda v: v is not None)[kind] & numbered
    loose = flag(laws, lambda v: v is not None and v.startswith("["))[law]
    of = doc * len(kinds) + kind
    exact, any_law = of * (len(laws) + 1) + law, of * (len(laws) + 1) + len(laws)
    # Distinct entries: the first of each in order of group and section as given.
    at = np.flatnonzero(entry)
    given = pc.fill_null(b.column(3), 0).to_numpy(zero_copy_only=False)[at]
    order = np.lexsort((numbered[at], given, exact[at]))
    at, given = at[order], given[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(exact[at]) != 0) | (np.diff(given) != 0) | (numbered[at][1:] != numbered[at][:-1])
    at = at[new]
    counts = ~entry & named & (high >= low) & (high - low <= widest)
    spans, shared = np.flatnonzero(counts), np.flatnonzero(counts & loose)
    groups, where = np.unique(np.concatenate([exact[spans], any_law[shared]]), return_inverse=True)
    start, end = (where * _APART + np.concatenate([v[spans], v[shared]]) for v in (low, high))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])

    def within(key: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(len(at), bool)
        k = np.minimum(np.searchsorted(groups, key), len(groups) - 1)
        n = k * _APART + low[at]
        last = np.searchsorted(start, n, "right") - 1
        return (groups[k] == key) & named[at] & (last >= 0) & (reach[last] >= n)

    hit = np.where(within(exact[at]), 0, np.where(within(any_law[at]), 1, 2)).astype(np.int32)
    words = pa.DictionaryArray.from_arrays(pa.array(hit), pa.array(["law", "ambiguous", "miss"])).cast(pa.string())
    return pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in range(4)), words], names=["doc_id", "law_key", "kind", "num_int", "hit"])
