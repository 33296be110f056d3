"""URL filters, filter audit and ranked search against brute force, with nulls, empty and long texts, ties, repeats, clashing columns."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from groundspark.llm import audit, ranked, urls
from groundspark.llm.urls import Rule

URLS = [
    "https://www.example.com/en/1", "http://blog.example.com/en/1?x=/en/", "HTTP://WWW.Example.COM/EN/1", "http://example.com", "http://example.com?a.com/", "http://notexample.com/en/",
    "http://a.net/es/x", "http://net/fr/", "http://a.net/es", "ftp://h.net:80/fr/q#z", "no scheme.com/en/", None, "", "://x.com/", "http://a.org/y?to=casino", "http://free-bets.org/", "http://mycasinos.org/",
    "http://museum.org/casino/", "http://x.org/\nbanner1-ad/", "http://x.org/banner1-ad/", "http://x.org/" + "a/" * 5000 + "poker-online", "http://é.com/ü", "http://a.net/es/x",
]


def verdict(url, rules, patterns):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    low = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (low == r.host or low.endswith(f".{r.host}")) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return low, path, best.name, best.action, None
    found = sorted((r.action, r.name) for r in patterns if re.search(r.regex.replace(r"\z", r"\Z"), low + rest[len(host) :]))
    return low, path, None, *(found[0] if found else ("allow", None))


@pytest.mark.parametrize("size", [urls.SLICE, 3])
def test_urls_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(urls, "SLICE", size)
    rows = spark.createDataFrame([(k, u, "h", "r", "v", "t") for k, u in enumerate(URLS)] + [(None, URLS[0], "", "", "", "")], "page_id long, url string, host string, rule string, _target string, token string")
    more = (Rule("block", "org", ""), Rule("allow", "museum.org", "/casino"))
    patterns = (*urls.PATTERNS, Rule("block", pattern="sinos."), Rule("block", pattern="*"))
    for rules, pats in ((urls.RULES, urls.PATTERNS), ((*urls.RULES, *more), patterns), ((), ())):
        got = {r["page_id"]: tuple(r)[1:] for r in urls.url_verdicts(rows, rules, pats).collect()}
        assert got == {k: verdict(u, rules, pats) for k, u in [*enumerate(URLS), (None, URLS[0])]}
    assert urls.url_verdicts(rows.limit(0)).count() == 0


def test_rules_are_indexed_by_their_rarest_token(spark):
    rule = Rule("block", "example.com", "/en/news")
    assert rule.tokens == ["com", "en", "example"]  # news can go on, as in /en/newsletter
    assert Rule("block", pattern="^free^bets*x^").tokens == ["free"] and Rule("block", pattern="free").tokens == []
    pages = spark.createDataFrame([(k, f"http://example{k}.com/en/") for k in range(5)] + [(9, "http://example.com/")], "page_id int, url string")
    assert urls.token_counts(pages, [rule]) == {"com": 6, "en": 5, "example": 1}
    for bad in (("deny", "a"), ("block", ""), ("block", "A.com"), ("block", "a", "/b?c")):
        with pytest.raises(ValueError):
            Rule(*bad)


def test_url_plan_is_native_and_has_no_shuffle(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string")
    plan = urls.url_verdicts(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


WORDS = ["alpha", "beta", "Gamma", "delta", "the", "of", "x"]
LONG = " ".join(f"w{k}" for k in range(30_000))
ROWS = [(k, " ".join(random.Random(k).choices(WORDS, k=random.Random(k).choice([0, 1, 150, 199, 200, 260]))), ["en", "de", None][k % 3]) for k in range(60)]
ROWS += [(100, None, "en"), (101, "", "en"), (102, " ", None), (103, LONG, "fr"), (104, LONG, "fr"), (105, LONG + "$", "fr"), (None, "", "en"), (None, LONG, "en"), (7, ROWS[7][1], "en"), (99, ROWS[7][1], "es")]
ROWS += [(200 + k, "same text | " * 30, "en") for k in range(40)] + [(300 + k, LONG[:3000] + str(k), "de") for k in range(40)] + [(5, "another text of id 5", "en")]


def audited(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails, out = [], defaultdict(Counter)
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((lang or "", {k for k in f if f[k]}, *labels.get(i, (0, 0))))
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, bad, good, toxic in fails:
            removed = False
            for s, f in enumerate(order, 1):
                c = out[part, order, s]
                hit = f in bad
                c["kept"] += not removed and not hit
                c["removed"] += not removed and hit
                c["redundant"] += removed and hit
                c["unique_fails"] += bad == {f}
                c["good_lost"] += not removed and hit and good == 1
                c["toxic_lost"] += not removed and hit and toxic == 1
                removed |= hit
    shapley = Counter()
    for (part, order, s), c in out.items():
        shapley[part, order[s - 1]] += c["removed"]
    return {k: (*(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(audit, "SAMPLES", 2)
    docs = spark.createDataFrame([(*r, 1, 2, True) for r in ROWS], "doc_id long, text string, lang string, part int, mask int, first boolean").repartition(5)
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2, "x") for k in range(0, 320, 2)] + [(2, 1, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    marks = {k: (k % 2, k % 3 // 2) for k in range(0, 320, 2)} | {2: (1, 1)}
    got = audit.filter_audit(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == audited(ROWS, marks)
    assert len(got) == 600 * len({r[2] for r in ROWS})
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert audit.filter_audit(docs, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_trie_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(audit, "SAMPLES", 4)
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", k=rng.randrange(12))).encode() for _ in range(2000)]
    trie, want = audit.Trie(), {}
    for k, t in enumerate(texts):
        trie.insert(t, (2000 - k,))
        want[t] = min(want.get(t, (2000 - k,)), (2000 - k,))
    assert dict(trie.terminals()) == want and sorted(trie.values()) == sorted(want.values())
    assert audit.shared(b"abcd", b"xxabce", 2) == 3 and audit.shared(b"", b"x", 0) == 0
    alike = spark.createDataFrame([("s" * 5000 + str(k % 300),) for k in range(3000)] + [("other",)] * 3000, "text string")
    bounds = audit.separators(alike, 8, 301)
    assert len(bounds) > 1 and all(len(b) > 5000 for b in bounds if b.startswith(b"sss"))  # as long as texts that begin alike need


def searched(docs, items, k=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(split(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c in held:
            if i is None or not c:
                continue
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("postings", [ranked.POSTINGS, 300])
def test_search_against_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "ÀB", "naïve", "𝒳1", "a_b", "A-B"]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.choice([0, 1, 5, 40, 400])))) for k in range(400)]
    docs += [(500, None), (501, " .,"), (None, "w1 w2"), (502, "w66 " * 20_000), (3, docs[3][1]), (503, docs[3][1]), (504, docs[3][1].upper())]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 60])))) for k in range(25)] + [(90, None), (91, ""), (92, "unknown"), (None, "w1"), (93, "w1 w1"), (93, "w5"), (94, docs[3][1])]
    d = spark.createDataFrame([(*x, 7, 1) for x in docs], "doc_id long, text string, n int, rank int").repartition(3)
    q = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, score int")
    got = Counter(tuple(r) for r in ranked.ranked_documents(d, q).collect())
    assert got == searched(docs, items)
    assert ranked.ranked_documents(d.limit(0), q).count() == 0 and ranked.ranked_documents(d, q.limit(0)).count() == 0
    monkeypatch.setattr(ranked, "BLOCK", 7)
    assert Counter(tuple(r) for r in ranked.ranked_documents(d, q, 3).collect()) == searched(docs, items, 3)


def test_accumulators_stop_where_nothing_can_reach_the_best():
    """The rare term fills k accumulators; documents that hold only frequent terms get none."""
    import numpy as np

    docs, k = 1000, 2
    term = np.concatenate([np.zeros(3, int), np.ones(docs, int)])
    row = np.concatenate([[5, 6, 7], np.arange(docs)])
    order = np.argsort(row, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(row))))
    shard = ranked.Shard(np.arange(docs), np.full(docs, 10), at, term[order], np.ones(len(term), int), docs, 10 * docs, 2)
    doc, score = shard.search(np.array([0, 1]), np.array([9000, 10]), k, 0)
    assert set(doc) == {5, 6, 7} and set(score) == {9010 * shard.base[0]}
