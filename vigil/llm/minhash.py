"""SuperMinHash signatures of shingle sets (the numeric core of operator 8).

Each element of a set draws, from its hash, a random order of the M registers, and a random fraction
for each step: at step j it offers the value ``j + fraction`` to the j-th register of its order, and a
register keeps the least offer. As one element never offers two values of one step, registers are
correlated in a way that lowers the variance of the similarity estimate. Elements go step by step
together; a document stops as soon as every register holds less than the next step could offer, which
for large sets is after the first step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vigil.llm.common import each_text, gram_hashes, mix, word_hashes

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_S32 = np.uint64(32)
#: Entries of the orders of elements that are held at once.
_AT_ONCE = 8 << 20


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text, hashes of the distinct k-word shingles in order; of the whole sequence if it has fewer words."""
    return [np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words for words in each_text(*word_hashes(texts))]


def _offer(elements: np.ndarray, step: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and places in the rest of the order that elements draw at a step."""
    with np.errstate(over="ignore"):
        x = mix(elements + np.uint64(step + 1) * _GOLD)
    return (x >> _S32) | np.uint64(step << 32), (x & _LOW) % np.uint64(m - step) + np.uint64(step)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` register values for each set; rows of empty sets hold the largest value."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max)
    if not sets:
        return out
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = out.reshape(-1)
    value, place = _offer(elements, 0, m)
    np.minimum.at(flat, owner * m + place.astype(np.int64), value)
    open_docs = np.flatnonzero((out.max(axis=1) >= np.uint64(1 << 32)) & (np.bincount(owner, minlength=len(sets)) > 0))
    per = max(1, _AT_ONCE // m)
    while len(open_docs):
        sizes = np.cumsum([len(sets[d]) for d in open_docs])
        n = max(1, int(np.searchsorted(sizes, per, side="right")))
        _steps(open_docs[:n], sets, out, m)
        open_docs = open_docs[n:]
    return out


def _steps(docs: np.ndarray, sets: list[np.ndarray], out: np.ndarray, m: int) -> None:
    """Steps from the second on for documents that still have registers to improve."""
    elements, owner = np.concatenate([sets[d] for d in docs]), np.repeat(docs, [len(sets[d]) for d in docs])
    order = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
    flat, rows = out.reshape(-1), np.arange(len(elements))
    for step in range(m):
        value, place = _offer(elements, step, m)
        place = place.astype(np.int64)
        chosen = order[rows, place]
        order[rows, place] = order[:, step]
        order[:, step] = chosen
        if step:
            np.minimum.at(flat, owner * m + chosen, value)
            if step + 1 == m:
                return
            still = (out[docs].max(axis=1) >= np.uint64((step + 1) << 32))
            if not still.all():
                docs = docs[still]
                if not len(docs):
                    return
                mask = np.isin(owner, docs)
                elements, owner, order = elements[mask], owner[mask], order[mask]
                rows = np.arange(len(elements))


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band of equally many registers, for each signature."""
    n, m = signature.shape
    h = np.zeros((n, bands), np.uint64)
    part = signature.reshape(n, bands, m // bands)
    with np.errstate(over="ignore"):
        for i in range(m // bands):
            h = mix(h * _GOLD + part[:, :, i])
    return h
