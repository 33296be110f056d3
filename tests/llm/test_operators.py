"""The ten operators on a small table with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from groundspark.llm import bpe, classifier, jaccard, lines, media, mixing, pii, rules, substring, suffix
from groundspark.llm.common import components

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam " * 3
TEXTS = [
    (1, LONG + "one", "a"), (2, LONG + "two", "a"), (3, "", "b"), (4, None, None), (5, "mail a.b@c.de or +49 (30) 123-4567 at 10.0.0.256 10.0.0.1, 4111 1111 1111 1111\nx", "b"),
    (6, "short\nshort\n***", "c"), (6, "short\nshort\n***", "c"), (None, LONG + "one", None), (7, "word " * 400 + "𝒳é 123!!", "a"), (8, "x" * 3000 + " end", "c"),
]
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "x", 0) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rid string, did int").repartition(3)


OPERATORS = {
    "pii": pii.personal_data, "mixing": mixing.mixed_words, "words": substring.deduplicated_words, "bytes": suffix.deduplicated_bytes, "rules": rules.quality_rules,
    "jaccard": jaccard.similar_groups, "media": media.media_columns,
    "bpe": lambda d: bpe.byte_bpe(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "lines": lambda d: lines.deduplicated_lines(d.select("doc_id", "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_and_none_for_none(docs, name):
    assert Counter(r["doc_id"] for r in OPERATORS[name](docs).collect()) == Counter(i for i, _, _ in TEXTS)
    assert OPERATORS[name](docs.where("doc_id > 99")).count() == 0


def test_personal_data(docs):
    got = next(r for r in pii.personal_data(docs).collect() if r["doc_id"] == 5)
    base = "email:5:13,ip:49:57,card:59:78,phone:17:34"
    assert (got["n_email"], got["n_ip"], got["n_card"], got["n_phone"]) == (1, 1, 1, 1)
    assert got["base_sha256"] == sha(base) and got["spans"] == base
    assert pii.sanitised("a b", "removed:0:1") == " b"
    assert list(pii.emails("@b.c@d.e")) == [(1, 8)] and list(pii.addresses("1.2.3.4.5.6.7.8")) == [(0, 7), (8, 15)]


def test_disclosures_against_brute_force(spark):
    """A word that stands only by mail addresses goes, one that is mostly there is generalised, one that is everywhere stays."""
    texts = [f"ordinary words about things write postbox user{k}@site{k}.org now" for k in range(8)]
    texts += [f"ordinary words about nothing at all number {'abcdefgh'[k % 8]}" for k in range(40)] + ["write now"]
    rows = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    words = [set(pii.TERM.findall(t)) for t in texts]
    have = [k for k, t in enumerate(texts) if "@" in t]

    def disclosure(term):
        n, both, entity, count = len(texts), sum(term in words[k] for k in have), len(have), sum(term in w for w in words)
        return np.log(n * both / (entity * count)) / np.log(n / entity)

    near = {t: disclosure(t) for t in ("ordinary", "words", "about", "things", "write", "postbox", "now")}
    for k in have:
        got = {(s.split(":")[0], texts[k][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in rows[k]["spans"].split(",")}
        want = {("removed" if d >= pii.REMOVE else "generalised", t) for t, d in near.items() if d >= pii.GENERALISE}
        assert got == want | {("email", f"user{k}@site{k}.org")}
        assert rows[k]["n_removed"] == 2 and rows[k]["n_generalised"] == 2
    assert all(rows[k]["spans"] == "" for k in range(8, len(texts)))


def test_words_and_bytes_against_brute_force(docs):
    seen, want = set(), {}
    for i, t, _ in sorted((x for x in TEXTS if x[0]), key=lambda x: x[0]):
        w = (t or "").split()
        keep = np.ones(len(w), bool)
        if i not in want:
            for k in range(len(w) - 19):
                if tuple(w[k : k + 20]) in seen:
                    keep[k : k + 20] = False
                seen.add(tuple(w[k : k + 20]))
            want[i] = (len(w), int((~keep).sum()), sha(" ".join(x for x, y in zip(w, keep, strict=True) if y)))
    for r in substring.deduplicated_words(docs).collect():
        if r["doc_id"]:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
        else:
            assert r["n_removed"] == r["n_words"]
    every = Counter(b[k : k + 400] for _, t, _ in TEXTS if (b := (t or "").encode()) for k in range(len(b) - 399))
    for most in (20_000, 1):
        for r in suffix.deduplicated_bytes(docs, most=most).collect():
            b = next((t or "") for i, t, _ in TEXTS if i == r["doc_id"]).encode()
            gone = {p for k in range(len(b) - 399) if every[b[k : k + 400]] > 1 for p in range(k, k + 400)}
            assert r["n_removed"] == len(gone) and r["kept_sha256"] == sha(bytes(x for p, x in enumerate(b) if p not in gone))


def test_tokens_are_those_of_the_library_and_decode_to_the_text(docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert ranks[base64.b64decode("IQ==")] == ranks[b"!"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in OPERATORS["bpe"](docs).collect():
        text = next((t or "") for i, t, _ in TEXTS if i == r["doc_id"])
        ids = own.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))


def test_mix_meets_targets(docs):
    rows = mixing.mixed_words(docs).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in rows)


def test_inner_names_as_input_columns(docs):
    clash = docs
    for name in ("_key", "_taken", "_size", "_first", "_part", "_did", "_turn", "size", "taken"):
        clash = clash.withColumn(name, F.lit(name))
    for kept in (mixing.mix_documents(clash), jaccard.one_of_each_group(clash)):
        assert kept.columns == clash.columns
        rows = kept.collect()
        assert rows and all(r[name] == name for r in rows for name in clash.columns if name.startswith("_"))
    assert mixing.mix_documents(clash).count() == mixing.mix_documents(docs).count()


def test_near_copies_and_lines(docs):
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    assert got[2] == 1 and got[None] == 1 and got[3] == 3 and got[4] == 4 and got[7] == 7
    assert jaccard.one_of_each_group(docs).columns == docs.columns
    kept = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.deduplicated_lines(docs.select("doc_id", "text")).collect()}
    assert kept[6] == ("short\n***", 1) and kept[4] == ("", 0) and kept[None][1] == 1


def test_media_round_trip_and_checksums():
    image = np.random.default_rng(1).integers(0, 256, (40, 64), dtype=np.uint8)
    for kind in range(3):
        rows = np.concatenate([np.full((40, 1), kind, np.uint8), media.filtered(image, kind)], axis=1)
        assert (media.unfiltered(rows) == image).all()
    stored = media.encode_png(image)
    assert (media.decode_png(stored) == image).all()
    with pytest.raises(ValueError):
        media.decode_png(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])
    assert media.payload(b"") == b"\0" * 64 and len(media.payload(b"a" * 64)) == 64


def test_classifier_tells_junk_apart(spark):
    good = "the quick brown fox number {} jumps over a lazy dog while many other animals look at it from far away"
    rows = [(i, good.format(i) if i % 4 else f"SPAM!!{i} " * 20) for i in range(400)]
    texts = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int")
    got = classifier.classified(texts, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 401 and held and sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) >= 0.95 * len(held)
    assert classifier.good_documents(texts, labels).columns == ["doc_id", "text"]


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (None, 3), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[100] == got[90] == 90


def test_rules_keep_clean_text(spark):
    clean = " ".join(f"ordinary word{chr(97 + k % 26)} sentence" for k in range(26))
    got = rules.quality_rules(spark.createDataFrame([(1, clean), (2, "A!! " * 9), (3, clean.upper())], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [True, False, False] and [r["base_failed"] for r in got] == [False, True, False]
