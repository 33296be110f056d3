"""Byte-level BPE: ranked merges as a fold of Spark's higher-order functions over the bytes of distinct words.

Documents are written in chunks, as codes of each chunk's distinct words. Words that many chunks hold are folded once for
all, up to a fixed number of them; a chunk folds the distinct words that are left, by the same fold with the ranks as a
literal, in the task that puts its documents together. So no text, word or id is shuffled but for the choice of the common
words, and work grows in proportion to the input. Decoding concatenates the bytes of ids.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import full_text, prepare, slices, written

#: Bytes of text whose words are coded together: what a task holds beside its batch.
CHUNK = 16 << 20
#: Longer pieces (in bytes) are merged by a heap, as the fold takes time with the square of a piece's length.
LONG = 128
#: Distinct words in a row of a chunk's words.
HELD = 1024
#: Bytes of documents' places that are put together at once, as what they stand for takes some 50 times as much.
PLACES = 1 << 18
#: Words that are folded once for all chunks, and their bytes at most: the bound of what is broadcast.
COMMON, SHORT = 1 << 20, 32
#: Bytes of a row group: so many that a file of chunks has one, as a task has to read all rows of a chunk.
WHOLE = 1 << 30
#: Fixed: white space by Unicode, which Java's \s leaves out.
_SPACE = "\\t-\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_NONE, _RANK_AT, _POSITION_AT = 1 << 17, 37, 17
_LOW, _ID = (1 << _RANK_AT) - 1, (1 << _POSITION_AT) - 1
_PLACE = _LOW - _ID


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks as the fold needs them: ids of single bytes, and the id that two adjacent ids merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs = {
            (ranks[t[:i]], ranks[t[i:]]): rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }

    def table(self) -> tuple[Column, Column]:
        """The merges as literals: where the row of each left id begins, and rows laid over each other where they have gaps.

        The place of (a, b) is begins[a] + b; what stands there carries its own pair, so that another pair is told from it.
        """
        rows: dict[int, list[int]] = {}
        for a, b in self.pairs:
            rows.setdefault(a, []).append(b)
        free = np.ones(4 * len(self.pairs) + len(self.tokens), bool)
        begins, entries = [0] * len(self.tokens), np.zeros(len(free) + len(self.tokens), np.int64)
        for a, bs in sorted(rows.items(), key=lambda row: (-len(row[1]), row[0])):
            own = np.array(bs)
            at = a
            while not free[(places := own + at % (len(free) - len(self.tokens)))].all():
                at += 7919
            begins[a], free[places] = int(at % (len(free) - len(self.tokens))), False
            entries[places] = [(a << 16 | b) << _POSITION_AT | self.pairs[a, b] for b in bs]
        said = lambda x: F.lit(json.dumps(x, separators=(",", ":")))
        return F.from_json(said(begins), "array<int>"), F.from_json(said(entries.tolist()), "array<bigint>")

    def byte_pairs(self) -> np.ndarray:
        """Ranks of the merges of two bytes, by 256 * a + b."""
        return np.array([self.pairs.get((a, b), _NONE) for a in self.bytes for b in self.bytes], np.int64)

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of one long piece, lowest rank first and then leftmost, by a heap over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        live: list[int | None] = list(ids)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if live[i] != left or j >= n or live[j] != right:
                continue
            live[i], live[j] = rank, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get((rank, live[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, live[k]))
            h = before[i]
            if h >= 0 and (r := self.pairs.get((live[h], rank))) is not None:
                heapq.heappush(heap, (r, h, live[h], rank))
        return [x for x in live if x is not None]


def _let(value: Column, use) -> Column:
    """Evaluates value once for use, where a plain reference would evaluate it each time."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_merges(state: Column, begins: Column, entries: Column) -> Column:
    """A piece's bytes (array<long>, as first_states gives them) folded to the ids of its tokens.

    Each element of the state packs the rank of its merge with the next one, the byte where it starts and its id, so
    that the least element is the leftmost merge of lowest rank. What stands at another pair's place differs from the
    pair in its upper bits, and counts as no merge. The table stands in the plan once, as the argument of a lambda.
    """
    return _let(begins, lambda b: _let(entries, lambda e: _folded(state, b, e)))


def _folded(state: Column, begins: Column, entries: Column) -> Column:
    def rank(left: Column, right: Column) -> Column:
        found = F.get(entries, F.get(begins, left.cast("int")) + right.cast("int"))
        pair = F.shiftleft(left, _POSITION_AT + 16) + F.shiftleft(right, _POSITION_AT)
        return F.shiftleft(F.least(found.bitwiseXOR(pair), F.lit(_NONE)), _RANK_AT)

    def merge(state: Column, _: Column) -> Column:
        def at(least: Column, p: Column) -> Column:
            token, before = F.shiftright(least, _RANK_AT), F.get(state, p - 2)
            new = rank(token, F.get(state, p + 1).bitwiseAND(_ID)) + least.bitwiseAND(_PLACE) + token
            old = rank(before.bitwiseAND(_ID), token) + before.bitwiseAND(_LOW)
            rest = F.slice(state, p + 2, F.lit(1 << 20))
            return F.when(p > 1, F.concat(F.slice(state, F.lit(1), p - 2), F.array(old, new), rest)).otherwise(F.concat(F.array(new), rest))

        def if_any(least: Column) -> Column:
            return F.when(least < (_NONE << _RANK_AT), _let(F.array_position(state, least).cast("int"), lambda p: at(least, p))).otherwise(state)

        return _let(F.array_min(state), if_any)

    steps = F.slice(state, F.lit(2), F.lit(1 << 20))
    return F.aggregate(steps, state, merge, lambda s: F.transform(s, lambda e: e.bitwiseAND(_ID).cast("int")))


def java_pattern(pattern: str) -> str:
    """The pattern with white space spelt out, for Java."""
    return pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")


_CHUNK = "chunk long, doc_id long, at binary, k int, words array<binary>"
_PART = "chunk long, doc_id long, at binary, k int, places binary, state array<long>, known array<int>"
_ENCODED = "doc_id long, ids array<int>, decoded binary"


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers up to 2**28 as bytes of 7 bits, the last of each under 128: a binary value for each range between cuts."""
    size = 1 + (values > 127) + (values > 16383) + (values > 2097151)
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(ends[-1], np.uint8)
    for k in range(4):
        has = np.flatnonzero(size > k)
        out[ends[has] + k] = (values[has] >> (7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts].astype(np.int32)), pa.py_buffer(out)])


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(data < 128)[:-1] + 1))
    within = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * within), start)


def first_states(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The fold's state for pieces' bytes before any merge; pairs: ranks of two adjacent bytes' merges, by 256 * a + b."""
    rank = np.full(len(data), _NONE, np.int64)
    rank[:-1] = pairs[data[:-1].astype(np.int64) * 256 + data[1:]]
    rank[offsets[1:] - 1] = _NONE
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return (rank << _RANK_AT) + (at << _POSITION_AT) + ids[data]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _chunked(pattern: str):
    """Documents' words by chunk: rows with a chunk's distinct words in the order of frequency, then a row for each document (at: its words' places in that order)."""

    def coded(chunk: int, docs: list, counts: list, pieces: list) -> Iterator[pa.RecordBatch]:
        found = pa.chunked_array(pieces).unify_dictionaries().combine_chunks()
        found = found if isinstance(found, pa.DictionaryArray) else pa.concat_arrays(found.chunks)
        index = found.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(index, minlength=len(found.dictionary)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        cuts = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        ids, words = pa.concat_arrays(docs), found.dictionary.cast(pa.binary()).take(pa.array(order))
        starts = np.arange(0, len(words), HELD, dtype=np.int32)
        if len(starts):
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, np.int32(len(words)))), words)
            yield _rows(_CHUNK, chunk, len(starts), k=pa.array(starts), words=lists)
        for lo in range(0, len(ids), 256):  # a few documents at a time, as numbers take many times the bytes of what is packed
            own = cuts[lo : lo + 257]
            yield _rows(_CHUNK, chunk, len(own) - 1, doc_id=ids[lo : lo + 256], at=packed(place[index[own[0] : own[-1]]], own - own[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, counts, pieces, size, chunk = [], [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            found = batch.column("pieces")
            if found.null_count:
                import regex

                split = regex.compile(pattern)
                texts = batch.column("rest").to_pylist()
                found = pa.array([split.findall(t) if p is None else p for p, t in zip(found.to_pylist(), texts, strict=True)], pa.list_(pa.string()))
            flat = found.flatten()
            docs.append(batch.column("doc_id"))
            counts.append(np.diff(found.offsets.to_numpy()))
            pieces.append(flat.dictionary_encode())
            size += flat.nbytes
            if size > 2 * CHUNK:  # pieces' offsets count too
                yield from coded(chunk, docs, counts, pieces)
                docs, counts, pieces, size, chunk = [], [], [], 0, chunk + 1
                pa.default_memory_pool().release_unused()
        if docs:
            yield from coded(chunk, docs, counts, pieces)

    return run


_TYPES = {
    "doc_id": pa.int64(), "at": pa.binary(), "k": pa.int32(), "words": pa.list_(pa.binary()), "places": pa.binary(),
    "state": pa.list_(pa.int64()), "known": pa.list_(pa.int32()),
}


def _rows(schema: str, chunk: int, n: int, **columns) -> pa.RecordBatch:
    """n rows of a chunk; columns that aren't given are null."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *(columns.get(c, pa.nulls(n, _TYPES[c])) for c in names[1:])], names)


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each stretch of a batch's rows that belongs to one chunk."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                yield int(chunk[lo]), batch.slice(lo, hi - lo)


def _starting(vocabulary: Vocabulary, shared):
    """Turns words into the fold's first states, or into their ids where they are long."""
    lut, pairs = np.array(vocabulary.bytes, np.int64), vocabulary.byte_pairs()

    def states(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        data, offsets = _binary(words)
        size = np.diff(offsets)
        short = size <= LONG
        ends = np.concatenate(([0], np.cumsum(np.where(short, size, 0))))
        state = _lists(first_states(data[np.repeat(short, size)], np.unique(ends), lut, pairs), ends)
        known = [None if ok else shared.value.merged(lut[data[a:b]].tolist()) for ok, a, b in zip(short.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return state, pa.array(known, pa.list_(pa.int32()))

    return states


def common_words(chunks: DataFrame, states, begins: Column, entries: Column) -> tuple[pa.Array, pa.Array]:
    """At most COMMON words, those that most chunks hold (two at least), and their ids, folded once for all chunks.

    Which words these are changes no result: a chunk folds the others itself.
    """
    held = chunks.select(F.explode("words").alias("word")).where(f"length(word) <= {SHORT}").groupBy("word").agg(F.count("*").alias("n"))
    counted = written(held.where("n > 1").select("word", F.floor(4 * F.log2("n")).alias("level")), "zstd")
    room, least = COMMON, None
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # some dozen levels
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    if least is None:
        return pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word")
            yield pa.RecordBatch.from_arrays([word, states(word)[0]], ["word", "state"])

    folded = counted.where(F.col("level") >= least).select("word").mapInArrow(run, "word binary, state array<long>")
    found = folded.select("word", fold_merges(F.col("state"), begins, entries).alias("ids")).toArrow().combine_chunks()
    if not len(found):
        return pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))
    return found["word"].chunk(0).cast(pa.binary()), found["ids"].chunk(0).cast(pa.list_(pa.int32()))


def _looked_up(states, common):
    """A chunk's words as places among the common ones, or as first states; its documents as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = common.value[0]
        for chunk, own in _by_chunk(batches):
            a_document = pc.is_null(own.column("words"))
            docs, held = own.filter(a_document), own.filter(pc.invert(a_document))
            if len(held):
                lists, first = held.column("words"), held.column("k").to_numpy().astype(np.int64)
                words, size = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
                k = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(words))
                at = pc.index_in(words, value_set=known_words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                known, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                yield _rows(_PART, chunk, 1, places=pa.array([np.concatenate((k[known], at[known])).tobytes()], pa.binary()))
                for lo in range(0, len(rest), 8192):
                    some = rest[lo : lo + 8192]
                    state, long = states(words.take(pa.array(some)))
                    yield _rows(_PART, chunk, len(some), k=pa.array(k[some], pa.int32()), state=state, known=long)
            if len(docs):
                yield _rows(_PART, chunk, len(docs), doc_id=docs.column("doc_id"), at=docs.column("at"))

    return run


def _assembled(tokens: list[bytes], common):
    """A chunk's documents with the ids of their words, and the bytes that the ids stand for."""

    def documents(docs: list, places: list, words: list) -> Iterator[pa.RecordBatch]:
        table, shared_ids = pa.array(tokens, pa.binary()), common.value[1]
        own_ids = [w.column("ids").cast(pa.list_(pa.int32())) for w in words]
        ids = pa.concat_arrays([shared_ids, *own_ids])
        k = np.concatenate([p[: len(p) // 2] for p in places] + [w.column("k").to_numpy() for w in words] + [np.zeros(0, np.int64)]).astype(np.int64)
        to = np.concatenate([p[len(p) // 2 :] for p in places] + [np.arange(len(shared_ids), len(ids))]).astype(np.int64)
        where = np.full(int(k.max()) + 1 if len(k) else 0, -1, np.int64)
        where[k] = to
        if (where < 0).any():
            raise ValueError("rows of one chunk are in different places")
        for batch in docs:
            for lo, hi in slices(_binary(batch.column("at"))[1], PLACES):
                own = batch.slice(lo, hi - lo)
                data, offsets = _binary(own.column("at"))
                words_before = np.concatenate(([0], np.cumsum(data < 128)))[offsets]
                taken = ids.take(pa.array(where[unpacked(data)]))
                flat = taken.flatten()
                size = np.concatenate(([0], np.cumsum(np.diff(taken.offsets.to_numpy()))))[words_before].astype(np.int32)
                decoded, cuts = _binary(table.take(flat))
                column = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cuts[size].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(decoded))])
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat), column], ["doc_id", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, places, words = None, [], [], []
        for chunk, own in _by_chunk(batches):
            if chunk != now:
                yield from documents(docs, places, words)
                now, docs, places, words = chunk, [], [], []
            a_document, a_word = pc.is_valid(own.column("at")), pc.is_valid(own.column("k"))
            docs.append(own.filter(a_document))
            words.append(own.filter(a_word))
            places += [np.frombuffer(p, np.int64) for p in own.column("places").drop_null().to_pylist()]
        yield from documents(docs, places, words)

    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, ids, and decoded: the bytes that the ids stand for.

    A null text counts as empty (no ids); a null doc_id is kept; repeated rows get equal results; pieces of any length
    are encoded; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = Vocabulary(read_ranks(ranks_path))
    begins, entries = vocabulary.table()
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary
    text = full_text()
    odd = F.col("text").rlike("\\p{Cn}")  # a letter of newer Unicode than Java knows
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.when(~odd, F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("pieces"),
        F.when(odd, F.col("text")).alias("rest"),
    )
    chunks = written(pieces.mapInArrow(_chunked(pattern), _CHUNK), "zstd", **{"parquet.block.size": WHOLE})
    states = _starting(vocabulary, shared)
    common = spark.sparkContext.broadcast(common_words(chunks, states, begins, entries))  # at most COMMON words of SHORT bytes
    parts = chunks.select("chunk", "doc_id", "at", "k", "words").mapInArrow(_looked_up(states, common), _PART)
    ids = F.when(F.col("k").isNotNull(), F.coalesce("known", fold_merges(F.col("state"), begins, entries))).alias("ids")
    return parts.select("chunk", "doc_id", "at", "k", "places", ids).mapInArrow(_assembled(vocabulary.tokens, common), _ENCODED)


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """For each row of docs (doc_id, text) the number of tokens, and digests of ids and of the decoded bytes (see encoded)."""
    said = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded(docs, ranks_path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
