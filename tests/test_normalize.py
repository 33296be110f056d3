"""Raw statute texts to bodies, article selection, outlines, audits: cases of broken lines, noise, scope and headings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from groundspark.operators import gold, normalize


def normal(spark, *texts):
    rows = normalize.normalized(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    return rows if len(rows) > 1 else rows[0]


def kinds(row):
    return [w["kind"] for w in row["warnings"]]


def test_broken_lines_are_joined_and_units_are_not(spark):
    a, b, c, d, e = normal(
        spark,
        "Điều 1. Phạm vi áp dụng\nQuy định này nói về dữ liệu của\ncơ quan và tổ chức liên quan\n1. Khoản đầu đứng riêng, không nối\nb) điểm cũng đứng riêng\nChương III\nĐiều 5. Thi hành",
        "Điều 1. Một\nCâu này đã hết.\nCâu kia đứng riêng",
        "Chương I\nQUY ĐỊNH CHUNG\nĐiều 1. Một\n1. Khoản bị ngắt vì\ntrang hẹp.",
        "Điều 1. Một\n  thụt đầu dòng\n\n   đoạn khác   \n  nối thêm",
        "Chương\nI bắt đầu\nkhông nối vào tiêu đề\nnối vào đây",
    )
    assert "dữ liệu của cơ quan" in a["body"] and a["n_lines_joined"] == 1
    assert {"1. Khoản đầu đứng riêng, không nối", "b) điểm cũng đứng riêng", "Chương III", "Điều 5. Thi hành"} <= set(a["body"].split("\n"))
    assert b["n_lines_joined"] == 0 and b["body"] == "Điều 1. Một\nCâu này đã hết.\nCâu kia đứng riêng\n"
    assert c["body"].split("\n")[:2] == ["Chương I", "QUY ĐỊNH CHUNG"] and "vì trang hẹp." in c["body"]
    assert d["body"] == "Điều 1. Một\n thụt đầu dòng\n\n đoạn khác nối thêm\n"  # one leading blank stays
    assert e["body"] == "Chương I bắt đầu\nkhông nối vào tiêu đề nối vào đây\n"  # a heading that joining made takes no more lines


def test_noise_characters_and_blanks(spark):
    a, b, c = normal(
        spark,
        "Điều 1. Một\n" + "CÔNG BÁO\nNội dung.\n" * 3 + "CÔNG BÁO\nHai lần.\nHai lần.\n12\nCuối.",
        "Điều 1. Một\nDữ\u00a0liệu bảo\u00advệ theo “quy định” – khoản 1.\r\n",
        "Điều 1. Một\nDư   thừa    blank.   \n\n\n\nĐiều 2. Hai\nNội dung.\n",
    )
    assert "CÔNG BÁO" not in a["body"] and a["body"].count("Hai lần.") == 2 and "\n12\n" not in a["body"] and a["n_lines_dropped"] == 5
    assert [(w["kind"], w["detail"]) for w in a["warnings"]] == [("repeated_lines", "1: CÔNG BÁO")]
    assert b["body"] == 'Điều 1. Một\nDữ liệu bảovệ theo "quy định" - khoản 1.\n'
    assert "Dư thừa blank.\n\nĐiều 2." in c["body"]


def test_scope(spark):
    rows = normal(
        spark,
        "QUỐC HIỆU\nCăn cứ Luật.\nĐiều 1. Một\nNội dung.", "QUỐC HIỆU\nChương I\nCHUNG\nĐiều 1. Một\nNội dung.", "Điều 1. Một\nNội dung.\nPHỤ LỤC\nMẫu số 1.",
        "Điều 1. Một\nNội dung.\nNơi nhận:\n- Như trên;", "Điều 1. Một\nNội dung.\n________________\nLuật này được thông qua.", "Một đoạn không có cấu trúc.", None, "",
    )
    assert [r["body"] for r in rows] == ["Điều 1. Một\nNội dung.\n", "Chương I\nCHUNG\nĐiều 1. Một\nNội dung.\n", *["Điều 1. Một\nNội dung.\n"] * 3, "Một đoạn không có cấu trúc.\n", "\n", "\n"]
    assert [r["n_lines_dropped"] for r in rows] == [1, 1, 1, 2, 1, 0, 0, 0]  # after lines were joined
    assert kinds(rows[2]) == ["cut_tail"] and kinds(rows[5]) == ["no_start", "no_article"] and kinds(rows[7]) == ["no_start", "no_article"]


def test_counts_and_gaps(spark):
    a, b = normal(spark, "Chương I\nCHUNG\nĐiều 1. Một\n1. A.\n2. B.\nĐiều 2. Hai\n1. C.", "\n".join(f"Điều {n}. X{k}\nY{k}." for k, n in enumerate((1, 2, 2, 1, 7))))
    assert (a["n_chapters"], a["n_articles"], a["n_clauses"], a["warnings"]) == (1, 2, 3, [])
    assert [tuple(g) for g in b["gaps"]] == [(2, 2), (2, 1), (1, 7)] and b["warnings"][0]["detail"] == "2->2, 2->1, 1->7"
    lines = spark.createDataFrame([("d", k, "article", n) for k, n in enumerate((1, 2, 2, 1))] + [("e", 0, "chapter", None)], "doc_id string, ln int, kind string, article_no int")
    found = {r["doc_id"]: r for r in gold.structure_counts(lines).collect()}
    assert [tuple(g) for g in found["d"]["gaps"]] == [(2, 2), (2, 1)] and found["e"]["gaps"] == [] and found["e"]["n_chapters"] == 1


def picked(spark, text, *numbers):
    docs = spark.createDataFrame([(1, text)], "doc_id int, body string")
    wanted = spark.createDataFrame([(1, n) for n in numbers] + [(2, 1)], "doc_id int, article_no int")
    return normalize.select_articles(docs, wanted).first()["body"]


def test_selection(spark):
    two = "Chương I\nCHUNG\nĐiều 1. Một\nNội dung một.\nĐiều 2. Hai\nNội dung hai.\nChương II\nTHI HÀNH\nĐiều 3. Ba\nNội dung ba."
    assert picked(spark, two, 2, 3) == "Chương I\nCHUNG\n\nĐiều 2. Hai\nNội dung hai.\n\nChương II\nTHI HÀNH\n\nĐiều 3. Ba\nNội dung ba.\n"
    assert picked(spark, two, 3) == "Chương II\nTHI HÀNH\n\nĐiều 3. Ba\nNội dung ba.\n"  # a heading without a kept article goes
    assert picked(spark, two) == "\n" and picked(spark, "", 1) == "\n"
    section = "Điều 1. Một\nNội dung một.\nMục 4\nBIỆN PHÁP\nBẢO ĐẢM\n\nlạc\nĐiều 9. Chín\nNội dung chín."
    assert picked(spark, section, 1) == "Điều 1. Một\nNội dung một.\n"
    assert picked(spark, section, 9) == "Mục 4\nBIỆN PHÁP\nBẢO ĐẢM\n\nĐiều 9. Chín\nNội dung chín.\n"  # text between a heading's block and its article goes
    pending = "Chương I\nCHUNG\nMục 1\nA\nĐiều 1. Một\nx.\nMục 2\nB\nĐiều 2. Hai\ny."
    assert picked(spark, pending, 2) == "Chương I\nCHUNG\n\n\nMục 2\nB\n\nĐiều 2. Hai\ny.\n"


def test_outline(spark):
    text = "Chương I\n\nCHUNG\nĐiều 1. Không khoản\nMột đoạn.\nMục 1\nĐiều 2. Dài\n1. " + "từ ngữ dài " * 700 + "\nChương II\nĐiều 3. Thử\n1. Một.\n3. Ba."
    found = normalize.outline(spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id int, body string"))
    rows = found.orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["seq"], r["chapter"], r["article_no"], r["title"], r["n_clauses"]) for r in rows] == [
        (1, 1, "Chương I — CHUNG", 1, "Không khoản", 0), (1, 2, "Chương I — CHUNG", 2, "Dài", 1), (1, 3, "Chương II", 3, "Thử", 2),
    ]
    assert [[w["kind"] for w in r["warnings"]] for r in rows] == [["no_clauses"], ["long"], ["clause_order"]] and rows[2]["warnings"][0]["detail"] == "[1, 3]"
    said = normalize.outline_text(found).first()["outline"].split("\n")
    assert said[0] == "Chương I — CHUNG" and said[1] == f"{'  Điều 1. Không khoản':<52} (0 khoản, 4 token)" and said[2].strip() == "! no_clauses" and said[5] == "Chương II"


def test_audit(spark):
    bodies = spark.createDataFrame([("a", "x" * 100), ("b", ""), ("c", "y")], "doc_id string, body string")
    articles = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "doc_id string, article_no int")
    chunks = spark.createDataFrame([("a", 0, 50, 10), ("a", 40, 70, 20), ("a", 90, 90, 31)], "doc_id string, s int, e int, n_tokens int")
    wanted = spark.createDataFrame([("a", 1), ("a", 3)], "doc_id string, article_no int")
    rows = {r["doc_id"]: tuple(r)[1:] for r in gold.corpus_audit(bodies, articles, chunks, wanted).collect()}
    assert rows == {"a": (2, 3, 20.0, 0.7, [3], [2]), "b": (1, 0, 0.0, 0.0, [], []), "c": (0, 0, 0.0, 0.0, [], [])}
    assert gold.corpus_audit(bodies, articles, chunks).where("size(missing) + size(extra) > 0").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_joining_against_a_loop(spark, seed):
    """Random lines that are blank, headings, numbered, half headings and sentence ends."""
    rng = random.Random(seed)
    pieces = ["", " ", "Chương", "I", "Chương II", "Điều", "5.x", "Điều 3. a", "Mục", "4", "1. k", "a) p", "chữ", " chữ ", "hết.", "mà:"]
    texts = [[rng.choice(pieces) for _ in range(rng.randrange(1, 30))] for _ in range(150)]
    heading = lambda x: re.match(r"Chương\s+[IVXLCDM]+|Mục\s+\d+|Điều\s+\d+\.", x)
    unit = lambda x: heading(x) or re.match(r"\d+\.\s|[a-zđ]\)\s", x)
    want = []
    for lines in texts:
        out, n = [], 0
        for line in lines:
            last = out[-1].strip() if out else ""
            if line.strip() and last and not unit(line.strip()) and not heading(last) and last[-1] not in ".;:!?":
                out[-1], n = f"{out[-1].rstrip()} {line.strip()}", n + 1
            else:
                out.append(line)
        want.append(("\n".join(out), n))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, ls array<string>").select("id", normalize.joined_lines(F.col("ls")).alias("j")).orderBy("id").collect()
    assert [(r["j"]["text"], r["j"]["n"]) for r in rows] == want
