"""Quality rules as a short-circuit cascade, ordered by rejections per cost as measured on a sample.

The counts that every row reports come first. Each rule then makes what else it needs, for the texts that no rule before
it has rejected.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import full_text, prepare
from groundspark.llm.textstats import counts

#: Rows that cost and selectivity are estimated on; they fix the order of the rules only, never a verdict.
SAMPLE_ROWS = 500
#: Counts of every text, whatever its verdict.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Rule = Callable[[pa.Array, dict[str, np.ndarray]], np.ndarray]


def symbol_heavy(texts: pa.Array, base: dict) -> np.ndarray:
    """Over three symbols to ten words."""
    return 10 * base["n_symbols"] > 3 * base["n_words"]


def shouting(texts: pa.Array, base: dict) -> np.ndarray:
    """Most letters are capitals."""
    own = counts(texts, ("n_upper", "n_letters"))
    return 10 * own["n_upper"] > 6 * np.maximum(1, own["n_letters"])


def odd_word_length(texts: pa.Array, base: dict) -> np.ndarray:
    """Mean word length outside 2 to 20 characters."""
    return (base["word_chars"] < 2 * base["n_words"]) | (base["word_chars"] > 20 * base["n_words"])


def repeated_lines(texts: pa.Array, base: dict) -> np.ndarray:
    """Over half of at least four lines equal an earlier one, so three do at least."""
    out, several = np.zeros(len(texts), bool), np.flatnonzero(base["n_dup_lines"] >= 3)
    lines = counts(texts.take(pa.array(several)), ("n_lines",))["n_lines"]
    out[several] = (lines >= 4) & (2 * base["n_dup_lines"][several] > lines)
    return out


def stuttering(texts: pa.Array, base: dict) -> np.ndarray:
    """Over three words of ten equal the word before."""
    return 10 * counts(texts, ("n_adjacent",))["n_adjacent"] > 3 * base["n_words"]


def shrinking(texts: pa.Array, base: dict) -> np.ndarray:
    """At least 200 bytes that deflate to under a twelfth: repetition that neither lines nor windows of words show."""
    raw = [t.encode() for t in texts.to_pylist()]
    return np.array([len(b) >= 200 and 12 * len(zlib.compress(b, 1)) < len(b) for b in raw], bool)


RULES: tuple[Rule, ...] = (symbol_heavy, shouting, odd_word_length, repeated_lines, stuttering, shrinking)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected), most rejections per second first; rules that reject none go last, cheap first."""

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = pa.array(batch.text, pa.string())
            base, out = counts(texts, BASE), []
            for rule in rules:
                began = time.perf_counter()
                rejected = float(rule(texts, base).sum())
                out.append((rule.__name__, time.perf_counter() - began, rejected, float(len(texts))))
            yield pd.DataFrame(out, columns=["rule", "s", "rejected", "n"])

    sample = docs.select(full_text().alias("text")).limit(rows)
    tried_rows = sample.mapInPandas(tried, "rule string, s double, rejected double, n double").groupBy("rule").sum().collect()
    measured = [(r["rule"], r["sum(s)"] / r["sum(n)"], r["sum(rejected)"] / r["sum(n)"]) for r in tried_rows]
    return sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[1], m[0]))


def rejected_by(texts: pa.Array, base: dict[str, np.ndarray], alive: np.ndarray, ordered: Sequence[Rule]) -> np.ndarray:
    """For each text the place of the rule that rejects it, len(ordered) for those that all let pass, -1 where not alive.

    A rule sees only the texts that are still alive.
    """
    out = np.full(len(texts), -1, np.int64)
    at = np.flatnonzero(alive)
    left, own = (texts, base) if len(at) == len(texts) else (texts.take(pa.array(at)), {k: v[at] for k, v in base.items()})
    for place, rule in enumerate(ordered):
        if not len(at):
            break
        bad = rule(left, own)
        if bad.any():
            out[at[bad]] = place
            at, left, own = at[~bad], left.filter(pa.array(~bad)), {k: v[~bad] for k, v in own.items()}
    out[at] = len(ordered)
    return out


_OUT = "doc_id long, " + "".join(f"{k} long, " for k in BASE) + "base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, the base verdict and whether every rule lets the text pass.

    The rules are tried in the order measured on the sample and the first that rejects ends the cascade, so the order
    changes cost, never a verdict. A null text counts as empty, which fails (under 20 words); a null doc_id is kept;
    repeated rows get equal results; other columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    rank = {name: k for k, (name, _, _) in enumerate(order_rules(docs, rules, sample_rows))}
    ordered = sorted(rules, key=lambda r: rank.get(r.__name__, len(rank)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            c = counts(texts, BASE)
            failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
            kept = rejected_by(texts, c, ~failed, ordered) == len(ordered)
            columns = [batch.column("doc_id"), *(pa.array(c[k]) for k in BASE), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text")).mapInArrow(judged, _OUT)
