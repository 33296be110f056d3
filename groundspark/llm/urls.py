"""URL filters: list rules and patterns, indexed by their rarest literal token; only rules that a URL's tokens fetch run their regular expression."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one literal index holds; longer lists take several indexes in turn, in the same pass over the pages.
SLICE = 4096
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule of the list (host and path prefix, the longest that fits decides) or, with an empty host, a pattern.

    In a pattern, * stands for anything and ^ for a separator or an end; letters match in any case. Where no rule of the
    list fits, a pattern that allows decides before those that block.
    """

    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    def __post_init__(self):
        if self.action not in ("allow", "block") or bool(self.host) == bool(self.pattern) or re.search("[?#]", self.path) or re.search("[/?#A-Z]", self.host):
            raise ValueError(f"no rule: {self}")

    @property
    def name(self) -> str:
        return self.host + self.path if self.host else self.pattern

    @property
    def regex(self) -> str:
        """Tested on host, path and what follows, without the scheme."""
        if self.host:
            return rf"^([^/?#]*\.)?{_quoted(self.host + self.path)}" + ("" if self.path else r"([/?#]|\z)")
        parts = {"*": "[^\n]*", "^": r"(?:[^A-Za-z0-9]|\A|\z)"}
        return "(?i)" + "".join(parts.get(c) or _quoted(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL which the rule fits holds whole; the last one of a path can go on, as one beside * can."""
        if self.host:
            found = re.findall(TOKEN, self.host)
            path = re.findall(f"{TOKEN}(?![a-z0-9]|$)", self.path.lower()) if self.path else []
            return sorted({*found, *path})
        return sorted(set(re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", f"*{self.pattern.lower()}*")))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text) if text.isascii() else re.escape(text)


#: The rules of the list that the query applies.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)
#: Patterns for URLs that no rule of the list fits: gambling, medicines, advertising, adult pages; sites about them are let through.
PATTERNS = tuple(
    Rule(action, pattern=p)
    for action, ps in (
        ("block", ("^casino^", "^free^bets^", "^cheap^pills^", "^ads^track^", "^adserver^", "^banner*ad^", "^porn*^", "^xxx^", "^adult^video*^", "^poker^online^")),
        ("allow", ("^gambling^help^", "^casino^history^", "^museum^")),
    )
    for p in ps
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host (A-Z lower-cased), path, and what comes after the scheme with the host lower-cased; all empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.regexp_extract(tail, r"\A[^?#]*", 0), F.concat(low, tail)


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(target), F.lit(TOKEN), F.lit(0)))


def token_counts(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules; at most one number a token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    target = url_parts(F.col("url"))[2]
    found = pages.select(F.explode(url_tokens(target)).alias("token")).where(F.col("token").isin(wanted)).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()} if wanted else {}


def _literal(value, schema: str) -> Column:
    """A constant of nested arrays; Spark folds it once when it plans."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _fitting(target: Column, tokens: Column, rules: Sequence[Rule], counts: dict[str, int]) -> Column:
    """The rules that fit (array of struct regex, action, name, n; n is -1 for patterns).

    The index is a table of buckets by CRC-32 of each rule's rarest token; rules without a token stand in a list that
    every URL meets.
    """
    size = 1 << max(1, len(rules).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    always = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
            buckets[zlib.crc32(rarest.encode()) % size].append({"t": rarest, "k": k})
        else:
            always.append(k)
    index = _literal(buckets, "array<array<struct<t:string,k:int>>>")
    known = _literal([{"regex": r.regex, "action": r.action, "name": r.name, "n": len(r.name) if r.host else -1} for r in rules], "array<struct<regex:string,action:string,name:string,n:int>>")
    fetched = F.flatten(F.transform(tokens, lambda t: F.transform(F.filter(F.get(index, (F.crc32(t.cast("binary")) % size).cast("int")), lambda e: e["t"] == t), lambda e: e["k"])))
    if always:
        fetched = F.concat(fetched, _literal(always, "array<int>"))
    candidates = F.transform(fetched, lambda k: F.get(known, k))
    return F.filter(candidates, lambda r: F.regexp_like(target, r["regex"]))


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Rule] = PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern), one row for each row of pages (page_id, url).

    rule is the list's longest rule that fits, else null; pattern is the pattern that decided where no rule fits, else
    null; verdict is theirs, and allow where neither fits. A null or schemeless url has an empty host and path, fits
    nothing and is allowed; a null page_id and repeated rows are kept as they are; other columns are ignored; an empty
    table gives none. Equal lengths can't both fit: a host has one suffix, a path one prefix of a length.

    One aggregation counts the rules' tokens, then a single pass without a shuffle judges the pages, in SLICE rules at
    a time.
    """
    every = [*rules, *patterns]
    counts = token_counts(pages, every)
    host, path, target = url_parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(target, F.lit("")).alias("_target"))
    rows = rows.withColumn("_tokens", url_tokens(F.col("_target")))
    fits = [_fitting(F.col("_target"), F.col("_tokens"), every[lo : lo + SLICE], counts) for lo in range(0, len(every), SLICE)]
    rows = rows.withColumn("_fits", F.concat(*fits) if fits else F.array().cast("array<struct<regex:string,action:string,name:string,n:int>>"))
    listed = F.array_max(F.transform(F.filter("_fits", lambda r: r["n"] >= 0), lambda r: F.struct(r["n"], r["name"], r["action"])))
    other = F.array_min(F.transform(F.filter("_fits", lambda r: r["n"] < 0), lambda r: F.struct(r["action"], r["name"])))
    rows = rows.withColumns({"_listed": listed, "_other": other})
    verdict = F.coalesce("_listed.action", "_other.action", F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_listed.name").alias("rule"), verdict.alias("verdict"), F.when(F.col("_listed").isNull(), F.col("_other.name")).alias("pattern"))


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({q(r.action)}, {q(r.host)}, {q(r.path)})" for r in RULES)
    patterns = ", ".join(f"({q(r.action)}, {q(r.pattern)}, {q(r.regex)})" for r in PATTERNS)
    return rf"""WITH r(action, host, path) AS (VALUES {listed}), p(action, pattern, regex) AS (VALUES {patterns}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
t AS (SELECT row_number() OVER () AS id, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS tail FROM h),
v AS (SELECT id, page_id, host, regexp_extract(tail, '^[^?#]*') AS path, host || tail AS target FROM t),
l AS (SELECT id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
  FROM v JOIN r ON (v.host = r.host OR suffix(v.host, '.' || r.host)) AND starts_with(v.path, r.path) GROUP BY id),
o AS (SELECT id, min(action) AS action, arg_min(pattern, (action, pattern)) AS pattern FROM v JOIN p ON regexp_matches(target, regex) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(l.action, o.action, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern FROM v LEFT JOIN l USING (id) LEFT JOIN o USING (id)"""


URL_SQL = _sql()
