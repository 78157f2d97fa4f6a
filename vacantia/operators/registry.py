"""Plug-in points: normalisers by board kind, ranking engines by key, lexicons as tables (matched by :mod:`vacantia.operators.dictionary`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia.operators import scoring_v1 as V1, scoring_v2 as V2
from vacantia.schemas import POSTING, RANKING, check
from vacantia.sources import boards as B

Normalizer = Callable[[DataFrame], DataFrame]
Engine = Callable[[DataFrame, Column, dict | None], DataFrame]

NORMALIZERS: dict[str, Normalizer] = {
    "greenhouse": B.normalize_greenhouse, "lever": B.normalize_lever, "ashby": B.normalize_ashby,
}
ENGINES: dict[str, Engine] = {}
#: The same engines as one struct column ``ranking`` beside the unchanged columns of the pairs, where an engine offers that form.
COLUMNS: dict[str, Engine] = {}


def register_normalizer(kind: str, fn: Normalizer) -> None:
    NORMALIZERS[kind] = fn


def normalize_all(landed: DataFrame) -> DataFrame:
    """Landed pages of all kinds (column ``kind``) through their normalisers, as one posting table."""
    result = None
    for kind, fn in sorted(NORMALIZERS.items()):
        rows = check(fn(landed.filter(F.col("kind") == kind)), POSTING, f"normaliser {kind}").withColumn("kind", F.lit(kind))
        result = rows if result is None else result.unionByName(rows)
    return result


def register_engine(key: str, fn: Engine, columns: Engine | None = None) -> None:
    """``fn`` gives ranking rows; ``columns``, if given, the pairs with a struct ``ranking`` of the same row added."""
    ENGINES[key] = fn
    COLUMNS.pop(key, None)
    if columns:
        COLUMNS[key] = columns


def rank(pairs: DataFrame, key: str, now: Column, config: dict | None = None) -> DataFrame:
    if key not in ENGINES:
        raise ValueError(f"unknown ranking engine {key}")
    return check(ENGINES[key](pairs, now, config), RANKING, f"engine {key}")


def shadow(pairs: DataFrame, now: Column, active: str, other: str) -> DataFrame:
    """Both engines on the same pairs with the difference per posting.

    Engines that add a column are chained over one pass, so the text features behind the pairs are computed once and nothing is
    joined; any other engine is joined by posting.
    """
    if active in COLUMNS and other in COLUMNS:
        rows = COLUMNS[active](COLUMNS[other](pairs, now, None).withColumnRenamed("ranking", "shadow"), now, None)
        both = rows.select("ranking.*", "shadow.score", "shadow.tier").toDF(*RANKING, "shadow_score", "shadow_tier")
        return both.withColumn("delta", F.col("shadow_score") - F.col("score"))
    first = rank(pairs, active, now)
    second = rank(pairs, other, now).select("job_id", F.col("score").alias("shadow_score"), F.col("tier").alias("shadow_tier"))
    return first.join(second, "job_id").withColumn("delta", F.col("shadow_score") - F.col("score"))


def _ranked(pairs: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], **fields: Column) -> DataFrame:
    """The pairs with ``ranking``; what the engine writes over an own column of the pairs (as the stored score) is put back."""
    own = {name: f"given_{name}" for name in pairs.columns if name in RANKING}
    rows = score(pairs.withColumns({given: F.col(name) for name, given in own.items()}))
    values = {"job_id": F.col("job_id"), "user_id": F.col("user_id"), "engine": F.lit(key), "score": F.col("score").cast("int"), **fields}
    ranking = F.struct(*[values.get(name, F.col(name)).cast(kind).alias(name) for name, kind in RANKING.items()]).alias("ranking")
    return rows.select(*[F.col(own.get(name, name)).alias(name) for name in pairs.columns], ranking)


def _first_columns(pairs: DataFrame, now: Column, config: dict | None) -> DataFrame:
    return _ranked(pairs, "v1", lambda rows: V1.score_v1(rows, now),
                   tier=V1.v1_tier(F.col("score")), confidence=F.lit("medium"), eligibility_state=F.lit("legacy"))


def _second_columns(pairs: DataFrame, now: Column, config: dict | None) -> DataFrame:
    return _ranked(pairs, "v2", lambda rows: V2.score_v2(rows, now, V2.fixed_config(config)))


register_engine("v1", lambda pairs, now, config: _first_columns(pairs, now, config).select("ranking.*"), _first_columns)
register_engine("v2", lambda pairs, now, config: _second_columns(pairs, now, config).select("ranking.*"), _second_columns)


def lexicon_frame(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """A term table as rows (ordinal, key, term) that can be written to Parquet or CSV and edited."""
    rows = [(i, key, term) for i, (key, term) in enumerate((k, t) for k, terms in table.items() for t in terms)]
    return spark.createDataFrame(rows, "ordinal int, key string, term string")
