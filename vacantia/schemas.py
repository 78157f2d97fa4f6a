"""Column contracts of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

POSTING = {
    "source_id": "bigint", "external_id": "string", "title": "string", "company": "string", "location": "string", "workplace": "string",
    "description": "string", "apply_url": "string", "source_url": "string", "published_at": "timestamp",
}
RANKING = {
    "job_id": "bigint", "user_id": "bigint", "engine": "string", "score": "int", "tier": "string", "confidence": "string",
    "eligibility_state": "string",
}


def conform(rows: DataFrame, contract: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the contract's columns and types; missing columns get their default (null unless given)."""
    defaults = defaults or {}
    return rows.select(*[
        (F.col(name) if name in rows.columns else F.lit(defaults.get(name))).cast(kind).alias(name) for name, kind in contract.items()])


def check(rows: DataFrame, contract: dict[str, str], what: str) -> DataFrame:
    """Fail early when a plug-in returns other columns or types than the contract."""
    found = dict(rows.dtypes)
    wrong = {n: (k, found.get(n)) for n, k in contract.items() if found.get(n) != k}
    if wrong:
        raise TypeError(f"{what} does not meet the contract: {wrong}")
    return rows.select(*contract)
