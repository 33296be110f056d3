"""Folding, search with offsets in the source, excerpts, and NFC's quick check, against plain Python."""

import json
import random
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from groundspark.functions import text as tx
from groundspark.operators import grep, structure
from groundspark.plans import retrieval


def slow_fold(text, accents):
    out, places = [], []
    for i, c in enumerate(text):
        piece = c.lower()
        if not accents:
            piece = "".join(x for x in unicodedata.normalize("NFD", piece) if not unicodedata.combining(x)).replace("đ", "d")
        out += piece
        places += [i] * len(piece)
    return "".join(out), places


ALPHABET = ["a", "A", "b", " ", "\n", "é", "é", "ế", "̣", "Đ", "đ", "İ", "ß", "Σ", "한", "𝒳", "ͅ", "ﬁ", "\\E", "."]


@pytest.mark.parametrize("accents", [False, True])
def test_folding_keeps_the_places_in_the_source(accents):
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(25)))
        folded, at, by = tx.fold(text, accents)
        want, places = slow_fold(text, accents)
        shift = lambda i: ([0] + [b for a, b in zip(at, by, strict=True) if a <= i])[-1]  # noqa: B023, E731
        assert folded == want and [i + shift(i) for i in range(len(folded))] == places
    assert tx.fold("plain ascii")[1:] == ([], []) and tx.fold("Điều Ổn") == ("dieu on", [], [])


def slow_excerpt(text, s, n, width):
    if len(text) <= width:
        lo, hi = 0, len(text)
    else:
        hi = min(len(text), max(s - max(0, (width - n) // 2), 0) + width)
        lo = max(0, hi - width)
    a, b = max(lo, s), min(hi, s + n)
    body = text[lo:a] + "»" + text[a:b] + "«" + text[b:hi] if a < b else text[lo:hi]
    return (("…" if lo else "") + body + ("…" if hi < len(text) else "")).replace("\n", " ")


@pytest.mark.parametrize("accents", [False, True])
def test_search_against_brute_force(spark, accents):
    rng = random.Random(5)
    docs = [(k, "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 30, 90])))) for k in range(60)] + [(100, "aaaa"), (101, None), (102, "AbABab" * 300)]
    cut = lambda t: t[(i := rng.randrange(len(t))) : i + rng.randrange(1, 6)]  # noqa: E731, F841
    needles = [(k, cut(t)) for k, (_, t) in enumerate(docs[:60]) if t] + [(200, "aa"), (201, "abab"), (202, "́"), (203, ""), (204, None), (205, "not there"), (206, "\\E"), (207, "a")]
    d = spark.createDataFrame(docs, "doc_id int, body string").repartition(3)
    n = spark.createDataFrame(needles, "needle_id int, needle string")
    want = set()
    for i, needle in needles:
        sought = slow_fold(needle or "", accents)[0]
        for k, body in docs if sought else ():
            hay, places = slow_fold(body or "", accents)
            at = hay.find(sought)
            while at != -1:
                s, e = places[at], places[at + len(sought) - 1] + 1
                want.add((i, k, s, e, slow_excerpt(body, s, e - s, 40)))
                at = hay.find(sought, at + 1)
    rows = grep.grep(n, d, accents=accents, width=40).collect()
    assert {tuple(r) for r in rows} == want
    kept = grep.folded_documents(d, accents)
    assert grep.grep(n, kept, accents=accents, width=40, index=grep.gram_index(kept)).count() == len(rows)
    assert grep.grep(n, d.limit(0), accents=accents).count() == 0 and grep.grep(n.limit(0), d, accents=accents).count() == 0


def test_search_without_overlapping_hits(spark):
    docs, needles = [(1, "aaaaa"), (2, "xÁbabáb abab"), (3, "aa"), (4, "b\\Ea\\Ea")], [(1, "aa"), (2, "abab"), (3, "\\Ea"), (4, "ab")]
    want = {(i, d, m.start(), m.end()) for i, n in needles for d, t in docs for m in re.finditer(re.escape(slow_fold(n, False)[0]), slow_fold(t, False)[0])}
    rows = grep.grep(spark.createDataFrame(needles, "needle_id int, needle string"), spark.createDataFrame(docs, "doc_id int, body string"), overlapping=False).collect()
    assert sorted((r["needle_id"], r["doc_id"], r["s"], r["e"]) for r in rows) == sorted(want) and (1, 1, 1, 3) not in want


def test_corpus_grep_counts_hits_as_its_sql_does(spark, tmp_path):
    spark.createDataFrame([(0, "banana na na na na na"), (8, "abababab")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "ababababababababab"), (2, "na na na na na na na")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for table in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = con.execute(retrieval.SQL["corpus_grep"]).fetchall()
    assert sorted(map(tuple, retrieval.q_corpus_grep(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 2


def test_hits_in_clauses_fragment_and_view(spark):
    body = "Chương I\nCHUNG\nĐiều 1. Phạm vi\nVăn bản này.\nĐiều 2. Giải thích\nLời dẫn.\n1. Một văn bản.\n2. Hai văn bản, văn bản.\n"
    bodies = spark.createDataFrame([("d", body)], "doc_id string, body string")
    lines = structure.lines(bodies)
    found = structure.articles(lines)
    clauses = structure.clauses(lines, found)
    hits = grep.grep(spark.createDataFrame([(1, "VAN BAN"), (2, "giai")], "needle_id int, needle string"), bodies)
    placed = grep.hits_in_clauses(hits, clauses)
    got = sorted((r["needle_id"], body[r["s"] : r["e"]], r["article_no"], r["clause_no"]) for r in placed.collect() if r["article_no"])
    assert got == [(1, "Văn bản", 1, 0), (1, "văn bản", 2, 1), (1, "văn bản", 2, 2), (1, "văn bản", 2, 2)]
    assert [r["clause_s"] for r in placed.where("needle_id = 2").collect()] == [None]  # it is in a title
    fragment = json.loads(grep.gold_fragment(placed, "q07").first()["fragment"])
    assert fragment["qid"] == "q07" and [body[s["char_start"] : s["char_end"]] for s in fragment["gold_spans"]] == ["Văn bản này.", "1. Một văn bản.", "2. Hai văn bản, văn bản."]
    titles = spark.createDataFrame([("d", "Luật X")], "doc_id string, title string")
    view = grep.article_view(found, clauses, bodies, titles, "d", 2).collect()
    assert [(r["label"], r["text"]) for r in view] == [("Điều 2 (đoạn mở đầu)", "Lời dẫn."), ("Điều 2 Khoản 1", "1. Một văn bản."), ("Điều 2 Khoản 2", "2. Hai văn bản, văn bản.")]
    assert view[0]["citation"] == "Điều 2 (đoạn mở đầu) Luật X" and body[view[0]["article_s"] : view[0]["article_e"]].startswith("Lời dẫn") and view[0]["article_title"] == "Giải thích"
    with pytest.raises(ValueError, match="it has 1, 2"):
        grep.article_view(found, clauses, bodies, None, "d", 9)
    with pytest.raises(ValueError, match="documents: d"):
        grep.article_view(found, clauses, bodies, None, "x", 1)


def test_nfc_quick_check_agrees_with_unicode(spark):
    """Every character that the pattern vouches for is in NFC on its own and after any other of them."""
    rng = random.Random(6)
    texts = ["", "plain", "ế", "é", "Å", "가", "가", "ậ", "Ω", None] + ["".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x1E00, 0x2100)])) for _ in range(5)) for _ in range(3000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", tx.nfc(F.col("t")).alias("n")).collect()
    assert all(r["n"] == (None if r["t"] is None else unicodedata.normalize("NFC", r["t"])) for r in rows)


def test_marked_characters(spark):
    got = spark.createDataFrame([("Đđếénñ",), ("",), (None,)], "t string").select(tx.diacritic_ratio(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in got] == [5 / 7, 0.0, 0.0]
