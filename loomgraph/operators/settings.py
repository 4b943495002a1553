"""Parameters of retrieval for a batch of queries: one set for all of them, or columns in which each query has its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.session import settled
from loomgraph.vocabulary import RANGES, Retrieval

KINDS = {name: {bool: "boolean", int: "int", float: "double"}[type(value)] for name, value in vars(Retrieval()).items()}


@dataclass
class Settings:
    """``params`` for every query, or ``rows`` with query_id and a column for each parameter."""

    params: Retrieval
    rows: DataFrame | None = None

    def limit(self, name: str, least: int = 0, times: int = 1) -> int | DataFrame:
        """A parameter ``times`` over, ``least`` at least: one number, or (query_id, most)."""
        if self.rows is None:
            return max(least, times * getattr(self.params, name))
        return self.rows.select("query_id", F.greatest(F.lit(least), F.lit(times) * F.col(name)).alias("most"))

    def onto(self, df: DataFrame, *names: str) -> DataFrame:
        """``df`` with each query's parameters as columns with a leading underscore."""
        if self.rows is None:
            return df.withColumns({f"_{n}": F.lit(getattr(self.params, n)).cast(KINDS[n]) for n in names})
        return df.join(self.rows.select("query_id", *[F.col(n).alias(f"_{n}") for n in names]), "query_id")

    def highest(self, name: str):
        """The highest value that any query has."""
        if self.rows is None:
            return getattr(self.params, name)
        found = self.rows.agg(F.max(name)).first()[0]
        return getattr(self.params, name) if found is None else found

    def asked_for(self, queries: DataFrame, name: str) -> DataFrame | None:
        """The queries that want something; none if no query does."""
        if self.rows is None:
            return queries if getattr(self.params, name) else None
        wanted = queries.join(self.rows.where(F.col(name)).select("query_id"), "query_id", "left_semi")
        return wanted if self.highest(name) else None


def as_settings(params: Retrieval | Settings) -> Settings:
    return params if isinstance(params, Settings) else Settings(params)


def settings_of(queries: DataFrame, params: Retrieval) -> Settings:
    """The settings of ``queries``: columns named as parameters are theirs, where they are not null; ``params`` holds for the
    others. Values out of range are an error."""
    params.check()
    own = [n for n in KINDS if n in queries.columns]
    if not own:
        return Settings(params)
    value = lambda n: F.coalesce(F.col(n).cast(KINDS[n]), F.lit(getattr(params, n)).cast(KINDS[n])) if n in own else F.lit(getattr(params, n)).cast(KINDS[n])
    rows = settled(queries.select("query_id", *[value(n).alias(n) for n in KINDS]))
    wrong = rows.where(~F.expr(" and ".join(f"{n} between {low} and {high}" for n, low, high in RANGES))).select("query_id", *[n for n, _, _ in RANGES]).first()
    if wrong is not None:
        raise ValueError(f"parameters out of range: {wrong.asDict()}")
    return Settings(params, rows)


def first_of_each(rows: DataFrame, order: list, limit: int | DataFrame, place: str = "place") -> DataFrame:
    """The first ``limit`` rows of each query, numbered from 1 in the column ``place``."""
    ranked = rows.withColumn(place, F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    if isinstance(limit, int):
        return ranked.where(F.col(place) <= limit)
    return ranked.join(limit, "query_id").where(F.col(place) <= F.col("most")).drop("most")


def weights(prefix: str = "_") -> tuple[Column, Column, Column]:
    """Graph, embedding and lexical weight from columns: none below 0, sum 1; without any, the defaults."""
    own = [F.greatest(F.lit(0.0), F.col(f"{prefix}{n}")) for n in ("graph_weight", "embedding_weight", "lexical_weight")]
    total = own[0] + own[1] + own[2]
    return tuple(F.when(total > 1e-9, w / total).otherwise(F.lit(d)) for w, d in zip(own, (0.62, 0.23, 0.15), strict=True))


def applied(prefix: str = "_") -> Column:
    """What was applied to a query, for the record: names and values as text."""
    g, e, x = weights(prefix)
    c = lambda n: F.col(f"{prefix}{n}")
    shown = {
        "top_k": c("top_k"), "max_hops": c("max_hops"), "beam_width": c("beam_width"), "prune_threshold": F.round(c("prune_threshold"), 6), "hybrid_enabled": c("hybrid"),
        "graph_weight": F.round(g, 6), "embedding_weight": F.round(e, 6), "lexical_weight": F.round(x, 6), "importance_weight": F.round(c("importance_weight"), 6),
        "recency_weight": F.round(c("recency_weight"), 6), "recall_half_life_hours": c("half_life_hours"), "rerank_enabled": c("rerank"), "rerank_top_n": c("rerank_top_n"),
        "rerank_weight": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("rerank_weight"))), 6),
    }
    return F.create_map(*[x for name, value in shown.items() for x in (F.lit(name), value.cast("string"))])


def resolved(rows: DataFrame, profiles: dict[str, Retrieval], common: dict | None, example_last: bool) -> DataFrame:
    """``rows(profile, request map<string,string>)`` with a column for each parameter: an example's own over those of all
    examples over its profile's; in the other order what a profile changes comes before both. Unknown names, and values that are
    none, are an error."""
    unknown = [r[0] for r in rows.select(F.explode(F.map_keys("request")).alias("k")).where(~F.col("k").isin(list(KINDS))).distinct().limit(10).collect()]
    unknown += sorted(set(common or {}) - set(KINDS))
    if unknown:
        raise ValueError(f"no such parameters: {', '.join(sorted(set(unknown)))}")
    text = lambda n: F.try_element_at("request", F.lit(n))
    truth = lambda t: F.when(F.lower(F.trim(t)).isin("true", "1"), F.lit(True)).when(F.lower(F.trim(t)).isin("false", "0"), F.lit(False))
    read = {n: truth(text(n)) if kind == "boolean" else text(n).try_cast(kind) for n, kind in KINDS.items()}
    wrong = rows.where(F.greatest(*[(text(n).isNotNull() & read[n].isNull()).cast("int") for n in KINDS]) == 1).select("request").first()
    if wrong is not None:
        raise ValueError(f"values that are none: {wrong['request']}")
    plain = Retrieval()

    def value(n: str) -> Column:
        lit = lambda v: F.lit(v).cast(KINDS[n])
        of_profile = lambda only: F.coalesce(*[F.when(F.col("profile") == p, lit(getattr(r, n) if not only or getattr(r, n) != getattr(plain, n) else None)) for p, r in profiles.items()])
        shared = lit((common or {}).get(n))
        order = [read[n], shared, of_profile(False)] if example_last else [of_profile(True), read[n], shared, lit(getattr(plain, n))]
        return F.coalesce(*order)

    return rows.select("*", *[value(n).alias(n) for n in KINDS])
