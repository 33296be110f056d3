"""Corpus folders: problems with their line, empty folders, order, quarantine, round trips; offsets and coverage as constraints."""

import pytest
from pyspark.sql import functions as F

from groundspark.operators import chunking, structure
from groundspark.sources import corpus

HEAD = "doc_id: {0}\ntitle: 'T {0}'\ndoc_type: law\nissued_date: 2020-01-01\neffective_from: 2020-02-01\neffective_to: null\nstatus: active"


def folder(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    return str(tmp_path)


def test_a_corpus_comes_in_order_and_nfc(spark, tmp_path):
    rows = corpus.load_corpus(spark, folder(tmp_path, {"2.txt": f"---\n{HEAD.format('a')}\n---\nBọ\r\n", "1.TXT": f"﻿---\n# note\n{HEAD.format('b')}\n---\nx", "n.md": "no"})).collect()
    assert [(r["doc_id"], r["title"], r["effective_to"], r["body"]) for r in rows] == [("a", "T a", None, "Bọ\n"), ("b", "T b", None, "x")]


def test_problems_raise_or_go_to_quarantine(spark, tmp_path):
    (tmp_path / "e").mkdir()
    with pytest.raises(FileNotFoundError, match="no .txt file"):
        corpus.load_corpus(spark, str(tmp_path / "e"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.load_corpus(spark, str(tmp_path / "nowhere"))
    files = {
        "a.txt": f"---\n{HEAD.format('a')}\n---\nx", "b.txt": f"---\n{HEAD.format('b')}\n\n2key: v\n---\nx", "c.txt": f"---\n{HEAD.format('c')}\n---\nx", "d.txt": f"---\n{HEAD.format('c')}\n---\ny",
        "e.txt": "no", "f.txt": f"---\n{HEAD.format('f').replace('active', 'odd')}\n---\n", "g.txt": "---\ndoc_id: g\ntitle: ''\n---\n",
    }
    made = folder(tmp_path / "e", files)
    good, bad = corpus.quarantined_corpus(spark, made)
    assert [r["doc_id"] for r in good.collect()] == ["a"]
    assert {r["source"][-5:]: r["problem"] for r in bad.collect()} == {
        "b.txt": "bad line 10: 2key: v", "c.txt": "repeated doc_id c", "d.txt": "repeated doc_id c", "e.txt": "no frontmatter", "f.txt": "bad status odd",
        "g.txt": "missing: title,doc_type,issued_date,effective_from,status",
    }
    with pytest.raises(Exception, match=r"\.txt: "):
        corpus.load_corpus(spark, made).collect()


def test_a_written_corpus_reads_back(spark, tmp_path):
    kind = "doc_id string, title string, doc_type string, issued_date string, effective_from string, effective_to string, status string, body string"
    docs = spark.createDataFrame([("a", 'Luật "A": b', "law", "2020-01-01", "2020", None, "active", "\n\nĐiều 1. X\n\n"), ("b", "B", "law", "1", "2", "3", "expired", "y")], kind)
    corpus.write_corpus(docs, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "file=a").glob("*.txt")).read_text()
    assert text == "---\ndoc_id: a\ntitle: \"Luật 'A': b\"\ndoc_type: law\nissued_date: \"2020-01-01\"\neffective_from: 2020\neffective_to: null\nstatus: active\n---\n\nĐiều 1. X\n"
    raw = spark.read.text(str(tmp_path / "out"), wholetext=True).select(F.lit("s").alias("source"), F.col("value").alias("text"))
    back = {r["meta"]["doc_id"]: r for r in corpus.parse_frontmatter(raw).collect()}
    assert back["a"]["problem"] is None and back["a"]["body"] == "\nĐiều 1. X\n" and back["b"]["meta"]["effective_to"] == "3"
    for column, said in (("title", "missing: title"), ("status", "missing: status")):
        with pytest.raises(Exception, match=said):
            corpus.write_corpus(docs.withColumn(column, F.lit("")), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="bad status x"):
        corpus.write_corpus(docs.withColumn("status", F.lit("x")), str(tmp_path / "bad"))


def test_offsets_and_coverage_are_constraints(spark):
    body = "Chương I\nCHUNG\nĐiều 1. Một\nLời dẫn.\n1. Là một.\n2. Là hai.\n"
    bodies = spark.createDataFrame([("d", body)], "doc_id string, body string")
    lines = structure.lines(bodies)
    found = structure.articles(lines)
    clauses = structure.clauses(lines, found)
    chunks = chunking.chunks(clauses, bodies, found)
    assert chunking.offset_problems(clauses, bodies).count() == 0
    assert chunking.checked_clauses(clauses, bodies).count() == 3 and chunking.checked_chunks(chunks, bodies).count() == chunks.count()
    moved = clauses.withColumn("s", F.col("s") + F.when(F.col("clause_no") == 1, 1).otherwise(0))
    assert [(r["clause_no"], r["problem"]) for r in chunking.offset_problems(moved, bodies).collect()] == [(1, "not at its number")]
    with pytest.raises(Exception, match="not at its number"):
        chunking.checked_clauses(moved, bodies).collect()
    for change, said in ((F.col("e") + 1000, "outside of the body"), (F.col("e") + 1, "blank at an end"), (F.col("s"), "outside of the body")):
        assert {r["problem"] for r in chunking.offset_problems(clauses.withColumn("e", change), bodies).collect()} == {said}
    assert chunking.offset_problems(clauses.withColumn("doc_id", F.lit("x")), bodies).first()["problem"] == "unknown document"
    with pytest.raises(Exception, match="no chunk covers"):
        chunking.checked_chunks(chunks.where("is_lead_in"), bodies).collect()
