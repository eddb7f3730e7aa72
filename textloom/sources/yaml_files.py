"""Gold queries and vocabularies in YAML files, as small DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

GOLD = "query_id string, query_text string, expected array<string>, category string, least_precision double"


def _load(path: str):
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries under ``queries`` or as a list; both spellings of the keys are read."""
    raw = _load(path) or []
    rows = raw.get("queries", []) if isinstance(raw, dict) else raw
    first = lambda r, *keys: next((r[k] for k in keys if r.get(k) is not None), None)
    return spark.createDataFrame([(str(first(r, "query_id", "id")), first(r, "query_text", "query"), [str(x) for x in first(r, "expected_doc_ids", "expected_docs") or []], first(r, "category", "difficulty"), float(first(r, "min_precision_at_5") or 0.0)) for r in rows], GOLD)


def write_gold_queries(queries: DataFrame, path: str) -> None:
    """A few hand-made queries, so that they are collected."""
    import yaml

    rows = [{"query_id": r.query_id, "query_text": r.query_text, "expected_doc_ids": list(r.expected), "category": r.category, "min_precision_at_5": r.least_precision} for r in queries.orderBy("query_id").collect()]
    Path(path).write_text(yaml.safe_dump({"queries": rows}, allow_unicode=True, sort_keys=False), encoding="utf-8")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(category, term) of a file of categories with lists; ``meta`` is left out."""
    raw = _load(path) or {}
    return spark.createDataFrame([(k, str(t)) for k, v in raw.items() if k != "meta" and isinstance(v, list) for t in v], "category string, term string")


def add_term(path: str, category: str, term: str) -> bool:
    """Adds a term to a category's list; False if it is there."""
    import yaml

    raw = _load(path) or {}
    if term in raw.setdefault(category, []):
        return False
    raw[category].append(term)
    Path(path).write_text(yaml.safe_dump(raw, allow_unicode=True, sort_keys=False), encoding="utf-8")
    return True
