"""Counts that quality rules and the quality classifier read from whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np

from groundspark.llm.common import Words, grams, mixed, slices, text_bytes

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_repeat_words", "n_adjacent", "n_distinct", "n_upper", "n_letters",
    "n_digits", "n_bang", "n_pipe", "n_stops", "n_lines", "n_dup_lines",
)
WINDOW = 8


def _lut(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_CLASSES = {
    "n_symbols": _lut(b"#*$%&|<>"),
    "n_upper": _lut(bytes(range(65, 91))),
    "n_letters": _lut(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])),
    "n_digits": _lut(bytes(range(48, 58))),
    "n_bang": _lut(b"!"),
    "n_pipe": _lut(b"|"),
    "n_stops": _lut(b".,;:?"),
}
_NOT_LINE = " \t\n\v\f\r"


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line.strip(_NOT_LINE):
            lines += 1
            seen.add(line)
    return lines, lines - len(seen)


def repeated_words(hashes: np.ndarray, doc: np.ndarray, docs: int, window: int = WINDOW) -> np.ndarray:
    """For each text: words covered by windows of consecutive words that occur twice or more in the text."""
    g = grams(hashes, window)
    if not len(g):
        return np.zeros(docs, np.int64)
    at = np.flatnonzero(doc[: len(g)] == doc[window - 1 :])
    key = mixed(g[at] ^ mixed(doc[at].astype(np.uint64)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs)


_OF_WORDS = {"n_words", "word_chars", "n_repeat_words", "n_adjacent", "n_distinct"}


def counts(column, wanted: tuple[str, ...] = COUNTS) -> dict[str, np.ndarray]:
    """The wanted of COUNTS for each text of an Arrow string column without nulls; no other is made."""
    out = {k: np.zeros(len(column), np.int64) for k in wanted}
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets) if out.keys() - {"n_lines", "n_dup_lines"} else ():
        piece, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        own = _word_counts(piece, at, out.keys()) if _OF_WORDS & out.keys() else {}
        for k in _CLASSES.keys() & out.keys():
            sums = np.concatenate(([0], np.cumsum(_CLASSES[k][piece], dtype=np.int64)))
            own[k] = sums[at[1:]] - sums[at[:-1]]
        for k, v in own.items():
            out[k][lo:hi] = v
    if {"n_lines", "n_dup_lines"} & out.keys():
        for i, text in enumerate(column.to_pylist()):
            for k, v in zip(("n_lines", "n_dup_lines"), duplicate_lines(text), strict=True):
                if k in out:
                    out[k][i] = v
    return out


def _word_counts(piece: np.ndarray, at: np.ndarray, wanted) -> dict[str, np.ndarray]:
    n, w = len(at) - 1, Words(piece, at)
    h, doc, own = w.hash[0], w.doc, {}
    if "n_words" in wanted:
        own["n_words"] = w.count
    if "word_chars" in wanted:
        points = np.concatenate(([0], np.cumsum((piece & 0xC0) != 0x80, dtype=np.int64)))
        own["word_chars"] = np.bincount(doc, points[w.end] - points[w.start], n).astype(np.int64)
    if "n_repeat_words" in wanted:
        own["n_repeat_words"] = repeated_words(h, doc, n)
    if "n_adjacent" in wanted:
        own["n_adjacent"] = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    if "n_distinct" in wanted:
        own["n_distinct"] = np.bincount(doc[np.unique(h ^ mixed(doc.astype(np.uint64)), return_index=True)[1]], minlength=n)
    return own
