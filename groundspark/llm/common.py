"""Helpers that several operators share: Arrow buffers, vectorised hashing of words and bytes, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are hashed together; bounds what a task holds beside its batch.
PIECE = 1 << 20
#: Rows in an Arrow batch: with texts of 100 kB each a batch stays near 25 MB.
BATCH_ROWS = 256
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1


@cache
def _own_folder() -> str:
    """A folder of this process, gone with it: for tests and single machines only."""
    folder = tempfile.mkdtemp(prefix="groundspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows, and gives checkpoints the folder that the cluster names; only a local session may do without one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: tasks need a folder that all machines share")
        spark.sparkContext.setCheckpointDir(shared or _own_folder())


def written(df: DataFrame, compression: str = "snappy", **options) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: cuts lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def full_text() -> Column:
    """A document's whole text; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from the columns of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_key(*columns: Column) -> Column:
    """64 bits that stand for a row where its columns can't be joined on; two rows that share them would be taken for one."""
    return F.xxhash64(*columns)


# --- Arrow buffers -----------------------------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string (or binary) column without nulls: their bytes, and offsets from 0."""
    _, offsets, data = column.buffers()
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes together, at least one document each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# --- hashing -----------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def _lower(table: np.ndarray) -> np.ndarray:
    table = table.copy()
    table[65:91] = table[97:123]
    return table


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n + 1, PIECE + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[base] = tuple(out)
    return _POWERS[base]


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end]; data is one piece."""
    table = _table(seed)
    power, inverse = _powers(_BASES[seed % 2], len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_lower(table) if lower else table)[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """The words of several texts: start, end (bytes in data), doc (index of the text) and hashes by seed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds=(0,), lower: bool = False):
        starts, ends, hashes = [], [], [[] for _ in seeds]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        lo = 0
        while lo < len(data):
            hi = min(len(data), lo + PIECE)
            if hi < len(data):  # a piece ends where no word does
                gaps = np.flatnonzero(_IS_SPACE[data[lo:hi]])
                while not len(gaps) and hi < len(data):
                    at, hi = hi, min(len(data), hi + PIECE)
                    gaps = np.flatnonzero(_IS_SPACE[data[at:hi]]) + (at - lo)
                hi = lo + int(gaps[-1]) + 1 if len(gaps) else len(data)
            piece = data[lo:hi]
            word = ~_IS_SPACE[piece]
            cut = edge[lo : hi + 1]
            before = np.concatenate(([False], word[:-1])) & ~cut[:-1]
            after = np.concatenate((word[1:], [False])) & ~cut[1:]
            s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
            for k, seed in enumerate(seeds):
                hashes[k].append(span_hashes(piece, s, e, seed, lower))
            starts.append(s + lo)
            ends.append(e + lo)
            lo = hi
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.end = join(starts, np.int64), join(ends, np.int64)
        self.hash = [join(x, np.uint64) for x in hashes]
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]

    def __len__(self) -> int:
        return len(self.start)


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of n consecutive items, for each start that has as many after it."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m, factor = len(hashes) - n + 1, np.uint64((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)[seed % 2])
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= factor
        out += hashes[j : j + m]
    return mixed(out)


def window_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the first least of `width` consecutive values is."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    at, step = np.arange(len(x)), 1
    while step * 2 <= width:
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        step *= 2
    if step < width:
        a, b = at[: len(x) - width + 1], at[width - step :]
        at = np.where(x[a] <= x[b], a, b)
    return at


# --- components --------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node that a path of edges (a, b) reaches.

    Each round hooks nodes to their least neighbour by pre-aggregated minima, jumps once, and contracts the edges, which
    shrink from round to round; the rounds' maps are joined at the end. Each round is written to the shared folder, so
    that no lineage grows and a lost executor costs one round at most. Nulls don't link; an empty table gives none.
    """
    edges = written(edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while edges.limit(1).count():
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        hooked = written(ends.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("near")).select("node", F.least("node", "near").alias("root")))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(hooked.join(above, "root").select("node", F.col("next").alias("root")))
        maps.append(jumped)
        of = lambda end: jumped.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))  # noqa: E731, B023
        moved = edges.join(of("a"), "a").join(of("b"), "b").where("ra != rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps.pop()
    while maps:
        last = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = maps.pop().join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return written(out.select("node", F.col("root").alias("component")))


def sequence_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of items[start:end], of any lengths."""
    power, inverse = _powers(_BASES[seed % 2], len(items))
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * power[: len(items)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray):
    """Unsigned hashes as Spark's longs."""
    import pyarrow as pa

    return pa.array(x.view(np.int64), pa.int64())


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of an Arrow list column of numbers; null lists are empty."""
    flat = column.flatten()
    at = column.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    if column.null_count:  # flatten() leaves out what null lists hold
        size = np.where(np.asarray(column.is_null()), 0, np.diff(at))
        at = np.concatenate(([0], np.cumsum(size)))
    return flat.to_numpy(zero_copy_only=False), at
