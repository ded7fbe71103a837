"""Mixing documents to target marginals by iterative proportional fitting.

Token counts are summed into cells of (source, language, topic); raking multiplies one factor per
value of each marginal until the cells' weighted tokens meet all three targets. A document's weight
is the product of its three factors, and it is sampled with probability min(1, rate * weight) by a
hash of its id, so the same documents come out of any run. A whole sample lowers the rate until no
cell with tokens is clipped at 1, so that the expected sampled tokens meet the targets too.

Cells are counted before they are collected: up to MAX_CELLS are raked in numpy on the driver; more
are raked as DataFrames, one aggregation and join a step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

MAX_CELLS = 200_000
SWEEPS = 12
TEMPER = 0.75
RATE = 0.7
MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
#: (part of the text, topic): the first that a text holds decides; `prose` where it holds none.
TOPICS = (("|", "table"), ("!!", "shouting"), ("icense", "licence"), ("@", "contact"))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for part, topic in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(part)), topic).otherwise(out)
    return out


def tempered(tokens: dict, exponent: float = TEMPER) -> dict:
    """Target shares: each value's share of the tokens to a power, made to sum to one."""
    total = sum(tokens.values()) or 1.0
    raised = {k: (v / total) ** exponent for k, v in tokens.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def rake(cells: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS) -> list[np.ndarray]:
    """Factors of each marginal's values. cells: a value number per marginal and cell; targets: shares."""
    total = tokens.sum()
    factors = [np.ones(len(t)) for t in targets]
    for _ in range(sweeps):
        for m, target in enumerate(targets):
            weighted = tokens * np.prod([f[c] for f, c in zip(factors, cells)], axis=0)
            now = np.bincount(cells[m], weighted, len(target))
            factors[m] = factors[m] * np.divide(target * total, now, out=np.ones(len(target)), where=now > 0)
    return factors


def _raked_on_driver(cells: DataFrame, targets: dict[str, dict] | None, sweeps: int) -> DataFrame:
    rows = cells.collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    values = {m: sorted({r[m] for r in rows}) for m in MARGINS}
    number = {m: {v: i for i, v in enumerate(values[m])} for m in MARGINS}
    at = [np.array([number[m][r[m]] for r in rows], np.int64) for m in MARGINS]
    shares = []
    for m, own in zip(MARGINS, at):
        sums = dict(zip(values[m], np.bincount(own, tokens, len(values[m])).tolist()))
        given = (targets or {}).get(m)
        want = {v: given.get(v, 0.0) for v in values[m]} if given else tempered(sums)
        whole = sum(want.values()) or 1.0
        shares.append(np.array([want[v] / whole for v in values[m]]))
    factors = rake(at, tokens, shares, sweeps)
    weight = np.prod([f[c] for f, c in zip(factors, at)], axis=0)
    out = [(*(r[m] for m in MARGINS), float(w)) for r, w in zip(rows, weight)]
    return cells.sparkSession.createDataFrame(out, ", ".join(f"{m} string" for m in MARGINS) + ", weight double")


def _raked_as_tables(cells: DataFrame, targets: dict[str, dict] | None, sweeps: int) -> DataFrame:
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("s"))
        if (targets or {}).get(m):
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} string, raised double")
            sums = sums.join(given, m, "left").select(m, F.coalesce("raised", F.lit(0.0)).alias("raised"))
        else:
            sums = sums.select(m, F.pow(F.col("s") / total, F.lit(TEMPER)).alias("raised"))
        whole = sums.agg(F.sum("raised")).first()[0] or 1.0
        wanted[m] = materialize(sums.select(m, (F.col("raised") / whole * total).alias("want")))
    state = materialize(cells.withColumn("weight", F.lit(1.0)))
    for _ in range(sweeps):
        for m in MARGINS:
            now = state.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now")).join(wanted[m], m)
            step = materialize(now.select(m, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("step")))
            new = materialize(state.join(step, m).withColumn("weight", F.col("weight") * F.col("step")).select(*MARGINS, "tokens", "weight"))
            release(state), release(step)
            state = new
    return state.select(*MARGINS, "weight")


def _mixed(docs: DataFrame, carry: list[str], id_col: str, text_col: str, targets, rate: float, sweeps: int, max_cells: int, whole: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {m: F.coalesce(F.col(m).cast("string"), F.lit("")) for m in ("source", "lang")} | {"topic": topic_of(text)}
    tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), F.col(id_col).alias("m_id"), *(own[m].alias(f"m_{m}") for m in MARGINS), tokens.alias("m_tokens"))
    cells = materialize(rows.groupBy(*(F.col(f"m_{m}").alias(m) for m in MARGINS)).agg(F.sum("m_tokens").alias("tokens")))
    few = cells.count() <= max_cells
    weights = materialize((_raked_on_driver if few else _raked_as_tables)(cells, targets, sweeps))
    if whole:
        top = cells.where("tokens > 0").join(weights, list(MARGINS)).agg(F.max("weight")).first()[0]
        rate = min(rate, 1 / top) if top else rate
    same = [F.col(f"m_{m}") == F.col(m) for m in MARGINS]
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("m_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    share = F.least(F.lit(1.0), F.lit(rate) * F.col("weight"))
    return rows.join(weights, same).withColumn("m_share", share).withColumn("m_in", uniform < share)


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, rate: float = RATE, sweeps: int = SWEEPS, max_cells: int = MAX_CELLS, whole: bool = False
) -> DataFrame:
    """One row per document: id, source, lang, topic, n_tokens, weight, probability, sampled.

    Columns source and lang must exist; their nulls are a value of their own, shown as empty. Null
    text has no tokens and the topic `prose`. targets: shares by marginal and value; a marginal that
    is not given gets its own tempered shares. Cells without tokens keep the factors they meet.
    Repeated rows draw the same lot. An empty table gives an empty result. Without `whole` the rate
    stands as given, and cells of weight above 1 / rate fall short of their targets.
    """
    out = _mixed(docs, [], id_col, text_col, targets, rate, sweeps, max_cells, whole)
    return out.select(
        F.col("m_id").alias(id_col), *(F.col(f"m_{m}").alias(m) for m in MARGINS), F.col("m_tokens").alias("n_tokens"),
        F.round("weight", 6).alias("weight"), F.round("m_share", 6).alias("probability"), F.col("m_in").alias("sampled"),
    )


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, rate: float = RATE) -> DataFrame:
    """The rows of docs that mixture(whole=True) samples, with all their columns."""
    out = _mixed(docs, docs.columns, id_col, text_col, targets, rate, SWEEPS, MAX_CELLS, True).where("m_in")
    return out.select(*(F.col(f"c_{c}").alias(c) for c in docs.columns))


def mixture_sql() -> str:
    """DuckDB SQL of mixture(whole=True) with its other parameters as they are: the sweeps unrolled into CTEs."""
    topic = "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{part}') THEN '{name}'" for part, name in TOPICS) + " ELSE 'prose' END"
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(t) AS n FROM cells)",
    ]
    for m in MARGINS:
        ctes.append(f"r_{m} AS MATERIALIZED (SELECT {m}, pow(sum(t) / any_value(n), {TEMPER}) AS r FROM cells, total GROUP BY {m})")
        ctes.append(f"w_{m} AS MATERIALIZED (SELECT {m}, r / (SELECT sum(r) FROM r_{m}) * n AS want FROM r_{m}, total)")
        ctes.append(f"f_{m}_0 AS MATERIALIZED (SELECT {m}, 1.0::DOUBLE AS f FROM r_{m})")
    at = dict.fromkeys(MARGINS, 0)
    for _ in range(SWEEPS):
        for m in MARGINS:
            joins = " ".join(f"JOIN f_{k}_{at[k]} AS x_{k} ON cells.{k} = x_{k}.{k}" for k in MARGINS)
            product = " * ".join(f"x_{k}.f" for k in MARGINS)
            now = f"SELECT cells.{m}, sum(t * ({product})) AS s FROM cells {joins} GROUP BY cells.{m}"
            ctes.append(f"f_{m}_{at[m] + 1} AS MATERIALIZED (SELECT p.{m}, p.f * CASE WHEN s > 0 THEN want / s ELSE 1 END AS f FROM f_{m}_{at[m]} p JOIN ({now}) q ON p.{m} = q.{m} JOIN w_{m} w ON p.{m} = w.{m})")
            at[m] += 1
    def joined(side: str) -> str:
        return " ".join(f"JOIN f_{k}_{at[k]} AS x_{k} ON {side}.{k} = x_{k}.{k}" for k in MARGINS)

    weight = " * ".join(f"x_{k}.f" for k in MARGINS)
    ctes.append(f"pace AS MATERIALIZED (SELECT coalesce(least({RATE}, 1 / max({weight})), {RATE}) AS rate FROM cells {joined('cells')} WHERE t > 0)")
    lot = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, d.source, d.lang, d.topic, n_tokens, round({weight}, 6) AS weight, "
        f"round(least(1.0, rate * ({weight})), 6) AS probability, {lot} < least(1.0, rate * ({weight})) AS sampled FROM d {joined('d')}, pace"
    )
