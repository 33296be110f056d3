"""Quality rules, Jaccard groups, media columns and the classifier's stage against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundspark.llm import classifier, jaccard, media, rules

SPACE = re.compile("[\x20\x09-\x0d]+")
words = lambda t: [w for w in SPACE.split(t or "") if w]


def counts_of(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeated = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def rejected(text):
    text = text or ""
    w = words(text)
    n, chars, symbols, _, _ = counts_of(text)
    lines = [x for x in text.split("\n") if words(x)]
    letters = len(re.findall("[A-Za-z]", text)) + sum(text.encode().count(b) for b in range(0xC3, 0xF5))
    return (
        10 * symbols > 3 * n or 10 * len(re.findall("[A-Z]", text)) > 6 * max(1, letters) or not 2 * n <= chars <= 20 * n
        or (len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines)) or 10 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 3 * len(w)
        or (len(text.encode()) >= 200 and 12 * len(zlib.compress(text.encode(), 1)) < len(text.encode()))
    )


def test_rules_see_only_what_rules_before_them_let_pass():
    seen = []

    def rule(name, bad):
        def run(texts, base):
            seen.append((name, texts.to_pylist(), base["n_words"].tolist()))
            return np.array([t in bad for t in texts.to_pylist()], bool)

        return run

    texts, base = pa.array(["a", "b", "c", "d", "e"]), {"n_words": np.arange(5)}
    ordered = [rule("first", "b"), rule("second", "cb"), rule("third", "ade"), rule("never", "")]
    got = rules.rejected_by(texts, base, np.array([True, True, True, False, True]), ordered)
    assert got.tolist() == [2, 0, 1, -1, 2]
    assert seen == [("first", ["a", "b", "c", "e"], [0, 1, 2, 4]), ("second", ["a", "c", "e"], [0, 2, 4]), ("third", ["a", "e"], [0, 4])]


def test_every_count_and_verdict_of_the_rules(spark):
    rng = random.Random(7)
    pieces = ["word", "other", "WORD", "a", "#", "x" * 30, "é", "naïve", "line\n", "\n", "\t", "same same", "𝒳"]
    texts = [" ".join(rng.choices(pieces, weights=[8, 8, rng.choice([1, 30]), 2, rng.choice([1, 9]), 1, 1, 1, 1, 1, 1, rng.choice([1, 9]), 1], k=rng.choice([0, 5, 19, 25, 60, 200]))) for _ in range(300)]
    texts += [None, "", "unique words of a clean text " * 1 + " ".join(f"w{k}" for k in range(30)), "one two three four five six seven eight " * 5, "w" * 2_000_000 + " end", "x " * 30_000, "row of words\n" * 30]
    rows = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, kept int, n_words string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in rules.quality_rules(rows).collect()}
    for k, t in enumerate(texts):
        n, chars, symbols, dup, again = counts_of(t)
        failed = n < 20 or 100 * again > 30 * n
        assert got[k] == (n, chars, symbols, dup, again, failed, not failed and not rejected(t)), k
    assert len(got) == len(texts) and any(r[-1] for r in got.values())


def test_groups_near_the_threshold(spark):
    """Texts a few words apart, so that similarities lie on both sides of 0.75; copies, ties, repeated rows and short texts."""
    rng = random.Random(8)
    docs = []
    for base in range(25):
        text = [f"b{base}w{k}" for k in range(rng.choice([6, 20, 45]))]
        for _ in range(rng.choice([1, 4, 9])):
            own = list(text)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5)}"
            docs.append(" ".join(own))
    docs += ["A b C d e", "a B c D E", "short one", "SHORT one", "", None, " \n", "rep " * 40, "rep " * 900]
    ids = list(range(len(docs))) + [3]
    table = spark.createDataFrame([(i, docs[i], "c", 0) for i in ids], "doc_id long, text string, component_id string, n_shingles int").repartition(4)

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = words(w)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(table).select("doc_id", "n_shingles", "component_id").collect()}
    assert links > 50 and got == {k: (len(s), find(k)) for k, s in enumerate(sets)}
    assert jaccard.similar_groups(table).count() == len(ids)


def test_fragments_bounds_and_sums():
    """Parity bits never promise less than two texts share; the fragments' shingles are the whole set, cut by range."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(900)]
    texts = [" ".join(base[: rng.choice([3, 60, 900])] + [f"y{k}" for k in range(rng.randrange(40))]) for _ in range(40)] + [""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["did", "doc_id", "text"])
    (described,) = jaccard._described(iter([batch]))
    (segments,) = jaccard._segments(iter([batch]))
    sets = [set() for _ in texts]
    for row in segments.to_pylist():
        assert all(t >> jaccard._FRAGMENT_BITS == row["fragment"] for t in row["tokens"])
        sets[row["did"]] |= set(row["tokens"])
    rows = described.to_pylist()
    assert [r["n"] for r in rows] == [len(s) for s in sets] and segments.num_rows == len(texts) * jaccard.FRAGMENTS
    near = 0
    for a, x in enumerate(rows):
        for b, y in enumerate(rows[:a]):
            differ = sum(((x[f"w{k}"] ^ y[f"w{k}"]) & (2**64 - 1)).bit_count() for k in range(jaccard.SIGNS))
            assert differ <= len(sets[a] ^ sets[b])
            near += differ > len(sets[a] ^ sets[b]) // 2
    assert near > 100


def test_a_large_group_around_the_threshold(spark):
    """Hundreds of variants of one text that share shingles in its prefixes, most of them on no side of 0.75 for long."""
    rng = random.Random(5)
    base = [f"v{k}" for k in range(70)]
    texts = []
    for _ in range(260):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(66)} for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(table).collect()}
    expected = {k: find(k) for k in range(len(texts))}
    assert got == expected and 3 < len(set(expected.values())) < 250


def naive_filter(image, kind):
    """A filter type for each row, as the PNG specification has them, byte by byte."""
    out = np.zeros((image.shape[0], image.shape[1] + 1), np.uint8)
    for y, row in enumerate(image.astype(int)):
        out[y, 0] = kind
        for x, v in enumerate(row):
            a, b = (row[x - 1] if x else 0), (image[y - 1, x] if y else 0)
            c = int(image[y - 1, x - 1]) if x and y else 0
            a, b = int(a), int(b)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x + 1] = (v - (0, a, b, (a + b) // 2, near)[kind]) % 256
    return out


def test_all_filters_of_png():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (23, 64), dtype=np.uint8)
    for kind in range(5):
        assert (media.unfiltered(naive_filter(image, kind)) == image).all()
    mixed = np.concatenate([naive_filter(image, k)[k::5] for k in range(5)])  # rows in another order: only shapes matter here
    assert media.unfiltered(mixed).shape == (23, 64)
    stored = media.encode_png(image)
    bad = zlib.compress(b"x")[:-3]
    body = stored[:33] + len(bad).to_bytes(4, "big") + b"IDAT" + bad + zlib.crc32(b"IDAT" + bad).to_bytes(4, "big") + stored[-12:]
    for broken in (b"", stored[:-5], body, stored[:8] + stored[33:]):
        with pytest.raises(ValueError):
            media.decode_png(broken)


def test_media_columns(spark):
    texts = ["", None, "a", "é" * 32, "a" * 63, "a" * 64, "a" * 65, "𝒳" * 5000, "text " * 40_000, "a"]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, media_bytes int").repartition(2)
    got = {r["doc_id"]: r for r in media.media_columns(rows).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = lambda a, b: tuple(got[a])[1:] == tuple(got[b])[1:]
    assert same(0, 1) and same(2, 9) and not same(4, 5)


def test_the_classifiers_stage_keeps_any_columns(spark):
    good = "the quick brown fox number {} jumps over a lazy dog while many other animals look at it from far away"
    rows = [(i, good.format(i) if i % 3 else f"SPAM!!{i} " * 20) for i in range(300)] + [(None, None), (5, good.format(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("_text", "_n_words", "_f0", "_positive", "c0", "C1", "score", "predicted", "label", "quality")
    wide = docs.select("*", *(F.lit(n).alias(n) for n in names))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, 9) for i in range(300)] + [(None, 1, 0, 9), (7, None, 0, 9)], "doc_id long, quality int, toxic int, text int")
    kept = classifier.good_documents(wide, labels)
    assert kept.columns == wide.columns
    found = kept.collect()
    want = {r["doc_id"] for r in classifier.classified(docs, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in found} == want and all(r[n] == n for r in found for n in names)
    assert sum(r["doc_id"] == 5 for r in found) == 2
    for empty in (docs.limit(0), wide.limit(0)):
        assert classifier.good_documents(empty, labels).count() == 0 and classifier.classified(empty, labels).count() == 0
    assert {r["score"] for r in classifier.classified(docs, labels.limit(0)).collect()} == {0.5}


def test_the_prior_comes_from_positives_and_unlabelled_rows():
    """Scores of 30,000 good and 20,000 other rows that overlap below: the prior is theirs, whatever the share of labels."""
    rng = np.random.default_rng(5)
    good, other = rng.normal(1, 1, 30_000), rng.normal(-2, 1, 20_000)
    for labelled in (500, 10_000):
        both = [np.histogram(-x, 1024, (-6, 6))[0] for x in (np.concatenate((good, other)), rng.choice(good, labelled, replace=False))]
        found = classifier.prior_from(np.stack([b / b.sum() for b in both], 1), 50_000, labelled)
        assert abs(found - 0.6) < 0.06


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.95])
def test_no_weights_nearby_have_less_risk(spark, prior):
    """The non-negative risk written out; at the highest prior the unbiased risk's negative part falls below 0."""
    rng = np.random.default_rng(6)
    x, positive = rng.normal(0, 1, (600, classifier.N)), np.zeros(600)
    x[:360, 0] += 2
    positive[:120] = 1
    rows = [(*map(float, v), int(p)) for v, p in zip(x, positive, strict=True)]
    table = spark.createDataFrame(rows, ", ".join(f"_f{k} double" for k in range(classifier.N)) + ", _positive int").repartition(3)
    start = classifier.Model(np.zeros(classifier.N), np.ones(classifier.N), np.zeros(classifier.N + 1), prior)
    x1 = np.concatenate((np.ones((600, 1)), x), 1)

    def risk(w):
        z = x1 @ w
        good, bad = np.logaddexp(0, -z), np.logaddexp(0, z)
        own = prior * good[positive > 0].mean()
        return own + max(0.0, bad.mean() - prior * bad[positive > 0].mean()) + classifier.RIDGE / 2 * (w @ w)

    w = classifier.minimised(table, start, prior).weights
    least = risk(w)
    assert least < risk(np.zeros(classifier.N + 1))
    assert all(least < risk(w + rng.normal(0, size, classifier.N + 1)) + 2e-3 for size in (0.01, 0.1, 0.5) for _ in range(200))


def test_labels_of_other_documents_change_no_score(spark):
    docs = spark.createDataFrame([(i, f"number {i} of some plain words in a row" if i % 4 else f"BUY!! {i} " * 9) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200)], "doc_id long, quality int")
    scores = lambda some: sorted((r["doc_id"], r["score"]) for r in classifier.classified(docs, some).collect())
    assert scores(labels) == scores(labels.where("quality = 1"))
