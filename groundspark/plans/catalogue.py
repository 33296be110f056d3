"""All registered queries of the reference's operators, and their SQL."""

from __future__ import annotations

from groundspark.plans import answers, evaluation, gold, replay, retrieval, statutes, texts

FAMILIES = (retrieval, texts, evaluation, answers, statutes, replay, gold)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
