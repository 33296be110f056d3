"""Exact substring deduplication of words by blocks of windows, in the manner of relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into blocks: all windows of WINDOW words that share their least anchor (a hash
of ANCHOR words) form a block, and equal windows always lie in blocks of equal anchors. A block that an earlier document
holds too goes as a whole; where a block is new but its anchor isn't, each window is looked up by itself. Blocks are
told by hashes of their windows, not as (position, length) factors of a reference, as the README says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Words, full_text, grams, lists, mixed, prepare, sequence_hashes, signed, slices, text_bytes, window_argmin

WINDOW, ANCHOR = 20, 5


class Parsed:
    """Windows of some texts: start (place of the first word), anchor (place), and words and their texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, seeds=(0, 1)):
        self.words = w = Words(data, offsets, seeds)
        self.gram = grams(w.hash[0], ANCHOR)
        owner = window_argmin(self.gram, window - ANCHOR + 1)
        if not len(owner):
            self.start, self.anchor = np.zeros(0, np.int64), owner
            return
        valid = w.doc[: len(owner)] == w.doc[window - 1 :]
        self.start = np.flatnonzero(valid)
        self.anchor = owner[valid]

    def anchor_hash(self) -> np.ndarray:
        return self.gram[self.anchor] >> np.uint64(8)

    def kept_to(self, own: np.ndarray) -> None:
        """Leaves those windows."""
        self.start, self.anchor = self.start[own], self.anchor[own]

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window (places in start) of each block."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], self.anchor[1:] != self.anchor[:-1])))
        return new, np.append(new[1:], len(self.start)) - 1


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            dids = np.asarray(batch.column("did"))
            for lo, hi in slices(offsets):
                p = Parsed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window, (0,))
                first, _ = p.blocks()
                doc, anchor, n = counted(p.words.doc[p.start[first]], p.anchor_hash()[first])
                yield pa.RecordBatch.from_arrays([signed(anchor), pa.array(dids[lo + doc]), pa.array(n)], ["anchor", "did", "n"])

    return run


def counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct keys, in order of their first places, and how often each occurs in it."""
    _, at, n = np.unique(mixed(key ^ mixed(doc.astype(np.uint64))), return_index=True, return_counts=True)
    order = np.argsort(at)
    at = at[order]
    return doc[at], key[at], n[order].astype(np.int32)


def _first_in_text(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries are the first of their key in their text."""
    out = np.zeros(len(key), bool)
    out[np.unique(mixed(key ^ mixed(doc.astype(np.uint64))), return_index=True)[1]] = True
    return out


def _member(doc: np.ndarray, key: np.ndarray, values: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether each text's list (values by offsets, texts lo to hi) holds the key."""
    own = values[offsets[lo] : offsets[hi]].view(np.uint64) if len(values) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
    return np.isin(mixed(key ^ mixed(doc.astype(np.uint64))), mixed(own ^ mixed(of.astype(np.uint64))))


def _candidates(batch: pa.RecordBatch, window: int):
    """Parsed texts of a batch, cut down to windows with repeated anchors."""
    data, offsets = text_bytes(batch.column("text"))
    values, cut = lists(batch.column("anchors"))
    for lo, hi in slices(offsets):
        if cut[lo] == cut[hi]:
            continue
        p = Parsed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window)
        p.kept_to(_member(p.words.doc[p.start], p.anchor_hash(), values, cut, lo, hi))
        yield lo, hi, p


def _block_keys(p: Parsed, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, last = p.blocks()
    start, end = p.start[first], p.start[last] + window
    return first, last, *(sequence_hashes(p.words.hash[k], start, end, k) for k in range(2))


def _blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids = np.asarray(batch.column("did"))
            for lo, _, p in _candidates(batch, window):
                first, _, b1, b2 = _block_keys(p, window)
                doc = p.words.doc[p.start[first]]
                new = _first_in_text(doc, b1)
                yield pa.RecordBatch.from_arrays([signed(b1[new]), signed(b2[new]), pa.array(dids[lo + doc[new]])], ["h1", "h2", "did"])

    return run


def _in_new_blocks(batch: pa.RecordBatch, lo: int, hi: int, p: Parsed, window: int) -> np.ndarray:
    """Which windows lie in blocks that occur nowhere earlier."""
    first, last, b1, _ = _block_keys(p, window)
    doc = p.words.doc[p.start[first]]
    values, cut = lists(batch.column("new_blocks"))
    new = _first_in_text(doc, b1) & _member(doc, b1, values, cut, lo, hi)
    return np.repeat(new, last - first + 1)


def _window_keys(p: Parsed, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(sequence_hashes(p.words.hash[k], p.start[at], p.start[at] + window, k) for k in range(2))


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids = np.asarray(batch.column("did"))
            for lo, hi, p in _candidates(batch, window):
                # Windows in repeated blocks are in the index by way of that block's first occurrence.
                at = np.flatnonzero(_in_new_blocks(batch, lo, hi, p, window))
                w1, w2 = _window_keys(p, at, window)
                doc = p.words.doc[p.start[at]]
                new = _first_in_text(doc, w1)
                yield pa.RecordBatch.from_arrays([signed(w1[new]), signed(w2[new]), pa.array(dids[lo + doc[new]])], ["h1", "h2", "did"])

    return run


def factors(dup_starts: np.ndarray, doc: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(text, first word, words) of the longest factors that runs of repeated windows make."""
    if not len(dup_starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], (np.diff(dup_starts) > window) | (np.diff(doc) != 0))))
    last = np.append(new[1:], len(dup_starts)) - 1
    return list(zip(doc[new].tolist(), dup_starts[new].tolist(), (dup_starts[last] - dup_starts[new] + window).tolist(), strict=True))


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            gone: dict[int, list[tuple[int, int]]] = {}
            values, cut = lists(batch.column("new_windows"))
            for lo, hi, p in _candidates(batch, window):
                dup = ~_in_new_blocks(batch, lo, hi, p, window)
                at = np.flatnonzero(~dup)
                w1, _ = _window_keys(p, at, window)
                doc = p.words.doc[p.start[at]]
                dup[at] = ~(_first_in_text(doc, w1) & _member(doc, w1, values, cut, lo, hi))
                starts = p.start[dup]
                docs = p.words.doc[starts]
                for d, s, n in factors(starts - p.words.first[docs], docs, window):
                    gone.setdefault(lo + d, []).append((s, s + n))
            rows = []
            for i, text in enumerate(texts):
                words = text.encode().split()
                keep = np.ones(len(words), bool)
                for s, e in gone.get(i, ()):
                    keep[s:e] = False
                kept = list(compress(words, keep.tolist())) if i in gone else words
                rows.append((len(words), len(words) - len(kept), len(gone.get(i, ())), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "n_factors", "kept_sha256"]
            )

    return run


def _earliest(keys: DataFrame, name: str) -> DataFrame:
    """For each document the keys that no earlier document has; minima are taken before the shuffle too."""
    first = keys.groupBy("h1", "h2").agg(F.min("did").alias("did"))
    return first.groupBy("did").agg(F.collect_list("h1").alias(name))


def deduplicated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs (doc_id, text): words, words removed, factors and a digest of the kept words.

    A word goes if a window of `window` words covers it whose sequence also starts earlier (smaller doc_id, or same
    document and earlier); windows are judged on the input. A null text has no words. Null doc_ids come after all
    others, in the order of a hash of their texts. Rows that share a doc_id are one place: neither is earlier than
    the other. Other columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    late = F.lit(2**63 - 1) - F.shiftrightunsigned(F.xxhash64("text"), 24)
    base = base.select(F.coalesce("doc_id", late).alias("did"), "doc_id", "text")
    anchors = base.select("did", "text").mapInArrow(_anchors(window), "anchor long, did long, n int")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    places = anchors.select("anchor", "did").join(repeated, "anchor").groupBy("did").agg(F.collect_list("anchor").alias("anchors"))
    found = base.join(places, "did", "left")
    new_blocks = _earliest(found.where("anchors is not null").mapInArrow(_blocks(window), "h1 long, h2 long, did long"), "new_blocks")
    found = found.join(new_blocks, "did", "left")
    new_windows = _earliest(found.where("anchors is not null").mapInArrow(_windows(window), "h1 long, h2 long, did long"), "new_windows")
    out = "doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string"
    return found.join(new_windows, "did", "left").mapInArrow(_parse(window), out)
