"""Exact byte-level deduplication over aligned segments, each block of them in positional prefix order.

Equal strings of LENGTH bytes have the same least anchor (a hash of ANCHOR bytes) at the same offset. All strings
whose anchor occurs more than once go, as aligned segments, to the block of their anchor. A block is sorted column by
column: the order of its segments by reversed prefix and the divergence of each from its neighbour are whole arrays
for each column, and a segment's longest match that ends at a column is the one with a neighbour in that order. No
run-compressed transform with sampled run ends is built, as the README says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import PIECE, full_text, lists, mixed, prepare, row_key, signed, slices, span_hashes, text_bytes, window_argmin, written
from groundspark.llm.substring import counted

LENGTH, ANCHOR = 400, 200
#: Documents at one index block (about 12 MB); anchors in more are counted string by string, pre-aggregated, which is
#: exact too.
MOST = 20_000
#: Segments whose blocks are built together.
PACK = 1500


def windows(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """For pieces of the texts: start of each window that lies in one text, its anchor's place, and the anchor's hash."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for lo in range(0, max(len(data) - length + 1, 0), PIECE):
        hi = min(len(data), lo + PIECE + length - 1)
        at = np.arange(hi - lo - anchor + 1)
        gram = span_hashes(data[lo:hi], at, at + anchor, 0)
        owner = window_argmin(gram, length - anchor + 1)
        start = np.arange(len(owner))
        valid = start + lo + length <= ends[lo : lo + len(owner)]
        start, owner = start[valid], owner[valid]
        yield start + lo, owner + lo, gram[owner]


def _anchors(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rids = np.asarray(batch.column("rid"))
            for lo, hi in slices(offsets):
                base = offsets[lo : hi + 1] - offsets[lo]
                at, keys = [], []
                for _, owner, gram in windows(data[offsets[lo] : offsets[hi]], base, length, anchor):
                    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
                    if len(new) and at and len(at[-1]) and at[-1][-1] == owner[0]:  # pieces share it
                        new = new[1:]
                    at.append(owner[new])
                    keys.append(gram[new] >> np.uint64(8))
                if at:
                    doc = np.searchsorted(base, np.concatenate(at), "right") - 1
                    doc, key, n = counted(doc, np.concatenate(keys))
                    yield pa.RecordBatch.from_arrays([signed(key), pa.array(rids[lo + doc]), pa.array(n)], ["anchor", "rid", "n"])

    return run


def _owned(batch: pa.RecordBatch, length: int, anchor: int, hot: bool):
    """(row, anchor hash, anchor place, first window, windows) for the repeated anchors of a batch's texts."""
    data, offsets = text_bytes(batch.column("text"))
    places, cut = lists(batch.column("anchors"))
    for lo, hi in slices(offsets):
        own = places[cut[lo] : cut[hi]]
        wanted = own < 0 if hot else own >= 0
        if not wanted.any():
            continue
        base = offsets[lo : hi + 1] - offsets[lo]
        of = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))[wanted]
        own = np.where(own < 0, -1 - own, own)[wanted]
        parts = []
        for start, owner, gram in windows(data[offsets[lo] : offsets[hi]], base, length, anchor):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
            doc = np.searchsorted(base, owner[first], "right") - 1
            key = lambda d, h: mixed(h ^ mixed(d.astype(np.uint64)))
            held = np.isin(key(doc, gram[first] >> np.uint64(8)), key(of, own.view(np.uint64)))
            m = np.repeat(held, np.diff(np.append(first, len(owner))))
            if m.any():
                parts.append((start[m], owner[m], gram[m]))
        if not parts:
            continue
        start, owner, gram = (np.concatenate([p[k] for p in parts]) for k in range(3))
        new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        count = np.diff(np.append(new, len(owner)))
        doc = np.searchsorted(base, owner[new], "right") - 1
        yield data[offsets[lo] : offsets[hi]], lo, base, doc, gram[new], owner[new], start[new], count


def _segments(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = np.asarray(batch.column("rid"))
            for data, lo, base, doc, gram, owner, start, count in _owned(batch, length, anchor, False):
                body = [data[s : s + n - 1 + length].tobytes() for s, n in zip(start.tolist(), count.tolist(), strict=True)]
                # A segment that its text repeats is repeated as a whole: one goes to the index, twice; the others are runs already.
                seen: dict[tuple, int] = {}
                lead = owner - start
                times = np.ones(len(body), np.int64)
                for k, key in enumerate(zip(doc.tolist(), gram.tolist(), lead.tolist(), body, strict=True)):
                    if (first := seen.setdefault(key, k)) != k:
                        body[k], times[k], times[first] = None, count[k], 2
                        gram[k] = mixed(gram[k : k + 1] + np.uint64(k))[0]  # spreads runs over tasks
                for k in range(0, len(body), 2000):
                    c = slice(k, k + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [signed(gram[c]), pa.array(rids[lo + doc[c]]), pa.array(start[c] - base[doc[c]]), pa.array(lead[c]), pa.array(times[c]), pa.array(body[c], pa.binary())],
                        ["anchor", "rid", "at", "lead", "times", "body"],
                    )

    return run


def _hot_windows(length: int, anchor: int):
    """A task's distinct windows at hot anchors, with how often it has each; given out whenever there are many."""

    def counted_up(held: list[tuple]) -> tuple:
        h1, h2, rid, at, n = (np.concatenate([x[k] for x in held]) for k in range(5))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
        return h1[new], h2[new], rid[order][new], at[order][new], np.add.reduceat(n[order], new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made = lambda x: pa.RecordBatch.from_arrays([signed(x[0]), signed(x[1]), *(pa.array(c) for c in x[2:])], ["h1", "h2", "rid", "at", "n"])
        for batch in batches:
            rids = np.asarray(batch.column("rid"))
            for data, lo, base, doc, _, _, start, count in _owned(batch, length, anchor, True):
                at = np.repeat(start, count) + _within(count)
                d = np.repeat(doc, count)
                keys = [np.zeros(len(at), np.uint64) for _ in range(2)]
                for k in range(2):
                    for a in range(0, len(data), PIECE):  # bounded memory for long texts
                        m = (at >= a) & (at < a + PIECE)
                        keys[k][m] = span_hashes(data[a : a + PIECE + length], at[m] - a, at[m] - a + length, k)
                held.append(counted_up([(*keys, rids[lo + d], at - base[d], np.ones(len(at), np.int64))]))
            if held:
                held = [counted_up(held)]
                if len(held[0][0]) > 200_000:
                    yield made(held.pop())
        if held:
            yield made(held.pop())

    return run


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def repeated_windows(bodies: list[bytes], leads: list[int], groups: np.ndarray, length: int, width: int) -> np.ndarray:
    """For distinct segments, aligned at their anchors and grouped (groups ascending): which windows occur in another one.

    width is the number of windows an anchor can own; column width - 1 + k is byte k of the anchor.
    """
    m, columns = len(bodies), width - 1 + length
    table = np.full((m, columns), 256, np.uint16)
    for i, (body, lead) in enumerate(zip(bodies, leads, strict=True)):
        at = width - 1 - lead
        table[i, at : at + len(body)] = np.frombuffer(body, np.uint8)
    table = np.ascontiguousarray(table.T)
    out = np.zeros((width, m), bool)
    order, since = np.arange(m), np.zeros(m + 1, np.int64)
    edge = np.concatenate(([True], groups[1:] != groups[:-1]))
    since[:-1][edge] = columns + 1
    since[m] = columns + 1  # a last neighbour that matches nothing
    for c in range(columns):
        symbols = table[c][order]
        if ((symbols[1:] != symbols[:-1]) & ~edge[1:]).any():  # else no run breaks
            at = np.argsort(groups * 257 + symbols, kind="stable")
            key = symbols[at]
            first = edge | np.concatenate(([True], key[1:] != key[:-1]))
            span = np.stack([np.concatenate(([0], at[:-1] + 1)), at + 1], 1)
            span[first] = (0, 1)
            since[:-1] = np.where(first, np.where(edge, columns + 1, c + 1), np.maximum.reduceat(since, span.ravel())[::2])
            order = order[at]
        s = c + 1 - length
        if s >= 0:
            out[s, order] = np.minimum(since[:-1], since[1:]) <= s
    return out.T


def _index(length: int, anchor: int):
    """Builds the blocks of a task's anchors, which come sorted, some at a time, and gives out runs of repeated windows."""
    width = length - anchor + 1

    def block(rows: list[tuple]) -> pa.RecordBatch:
        distinct: dict[tuple, list[int]] = {}
        for k, (a, _, _, lead, times, body) in enumerate(rows):
            distinct.setdefault((a, lead, body), []).extend([k] * times)
        keys = sorted(distinct)
        groups = np.cumsum([k and keys[k][0] != keys[k - 1][0] for k in range(len(keys))])
        repeated = repeated_windows([k[2] for k in keys], [k[1] for k in keys], groups, length, width)
        out = ([], [], [])
        for i, key in enumerate(keys):
            n = len(key[2]) - length + 1
            own = repeated[i, width - 1 - key[1] :][:n]
            if len(distinct[key]) > 1:
                own = np.ones(n, bool)
            turns = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).tolist()
            for k in dict.fromkeys(distinct[key]):
                for s, e in zip(turns[::2], turns[1::2], strict=True):
                    out[0].append(rows[k][1])
                    out[1].append(rows[k][2] + s)
                    out[2].append(rows[k][2] + e)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            runs = batch.filter(batch.column("body").is_null())
            yield pa.RecordBatch.from_arrays([runs.column("rid"), runs.column("at"), pc.add(runs.column("at"), runs.column("times"))], ["rid", "start", "end"])
            whole = batch.filter(batch.column("body").is_valid())
            for row in zip(*(whole.column(k).to_pylist() for k in ("anchor", "rid", "at", "lead", "times", "body")), strict=True):
                if len(held) >= PACK and row[0] != held[-1][0]:
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


def _removed(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            runs = [[(r["start"], r["end"]) for r in x or ()] for x in batch.column("runs").to_pylist()]
            single = [set(x or ()) for x in batch.column("single").to_pylist()]
            for _, lo, base, doc, _, _, start, count in _owned(batch, length, anchor, True):
                for d, s, n in zip(doc.tolist(), (start - base[doc]).tolist(), count.tolist(), strict=True):
                    runs[lo + d] += [(k, k + 1) for k in range(s, s + n) if k not in single[lo + d]]
            rows = []
            for text, own in zip(texts, runs, strict=True):
                body = text.encode()
                spans: list[list[int]] = []
                for s, e in sorted(own):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e - 1 + length)
                    else:
                        spans.append([s, e - 1 + length])
                digest, last = hashlib.sha256(), 0
                for s, e in spans:
                    digest.update(body[last:s])
                    last = e
                digest.update(body[last:])
                rows.append((len(body), sum(e - s for s, e in spans), len(spans), digest.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def deduplicated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """One row for each row of docs (doc_id, text): bytes, bytes removed, maximal removed runs, digest of what is kept.

    Each byte covered by a string of `length` bytes goes if the string starts anywhere else too; strings lie in one
    text and are judged on the input. A null text counts as empty; null doc_ids are kept; a repeated row is another
    place, so both lose what they share. Other columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    base = base.select(row_key("doc_id", "text").alias("rid"), "doc_id", "text")
    anchors = base.select("rid", "text").mapInArrow(_anchors(length, anchor), "anchor long, rid long, n int")
    anchors = written(anchors)
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where("n > 1").select("anchor", (F.col("docs") > most).alias("hot"))
    key = F.when(F.col("hot"), -1 - F.col("anchor")).otherwise(F.col("anchor"))
    places = anchors.select("anchor", "rid").join(repeated, "anchor").groupBy("rid").agg(F.collect_set(key).alias("anchors"))
    found = base.join(places, "rid", "left")
    own = found.where("anchors is not null")
    segments = own.mapInArrow(_segments(length, anchor), "anchor long, rid long, at long, lead long, times long, body binary")
    runs = segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index(length, anchor), "rid long, start long, end long")
    runs = runs.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    hot = own.where(F.exists("anchors", lambda a: a < 0)).mapInArrow(_hot_windows(length, anchor), "h1 long, h2 long, rid long, at long, n long")
    single = hot.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("rid").alias("rid"), F.max("at").alias("at")).where("n = 1")
    single = single.groupBy("rid").agg(F.collect_set("at").alias("single"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return found.join(runs, "rid", "left").join(single, "rid", "left").mapInArrow(_removed(length, anchor), out)
