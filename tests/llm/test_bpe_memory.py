"""What a task of the encoder holds beside its batch doesn't grow with its chunk."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from groundspark.llm import bpe

TEXTS = [[f"w{(7 * d + i * i) % 901}" for i in range(d % 50)] for d in range(2000)]


def coded(monkeypatch):
    """The rows of one chunk, and how many numbers were packed at once."""
    sizes, packed = [], bpe.packed
    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(bpe, "packed", lambda values, cuts: (sizes.append(len(values)), packed(values, cuts))[1])
    batch = lambda lo: pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 250)), pa.array(TEXTS[lo : lo + 250], pa.list_(pa.string())), pa.nulls(250, pa.string())], ["doc_id", "pieces", "rest"])
    return list(bpe._chunked("")(batch(lo) for lo in range(0, len(TEXTS), 250))), sizes


def test_a_chunk_is_packed_a_few_documents_at_a_time(monkeypatch):
    rows, sizes = coded(monkeypatch)
    words, at = [], {}
    for row in (r for batch in rows for r in batch.to_pylist()):
        if row["words"] is not None:
            words += row["words"]
        else:
            at[row["doc_id"]] = bpe.unpacked(np.frombuffer(row["at"], np.uint8)).tolist()
    assert [[words[k].decode() for k in at[d]] for d in range(len(TEXTS))] == TEXTS and len(set(words)) == len(words)
    assert max(sizes) <= 256 * 50


def test_documents_are_put_together_by_the_bytes_of_their_places(monkeypatch):
    monkeypatch.setattr(bpe, "PLACES", 100)
    rows, _ = coded(monkeypatch)
    ids = {w: k for k, w in enumerate({w for t in TEXTS for w in t})}
    tokens = [w.encode() for w in ids]

    def parts():
        for batch in rows:
            words = [w for ws in batch.column("words").drop_null().to_pylist() for w in ws]
            if words:
                yield bpe._rows(bpe._PART, 0, len(words), k=pa.array(range(len(words)), pa.int32())).append_column("ids", pa.array([[ids[w.decode()]] for w in words], pa.list_(pa.int32())))
            else:
                own = bpe._rows(bpe._PART, 0, len(batch), doc_id=batch.column("doc_id"), at=batch.column("at"))
                yield own.append_column("ids", pa.nulls(len(own), pa.list_(pa.int32())))

    common = SimpleNamespace(value=(pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))))
    got = list(bpe._assembled(tokens, common)(parts()))
    assert [(r["doc_id"], r["decoded"].decode()) for b in got for r in b.to_pylist()] == [(d, "".join(t)) for d, t in enumerate(TEXTS)]
    assert all(len(b) == 1 or sum(len(bpe.packed(np.array(r["ids"], np.int64), np.array([0, len(r["ids"])]))[0].as_py()) for r in b.to_pylist()) <= 400 for b in got)
