"""Graph patterns over streams of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..operators.store import GraphStore
from ..plans.executor import Engine
from ..plans.syntax import Select, parse


def match_stream(stream: DataFrame, store: GraphStore, text: str, seed: int = 0) -> DataFrame:
    """Solutions of a query whose pattern number `seed` is met by the stream's triples (s, p, o), the others by the store.

    A stream-static join: stateless, so it needs no watermark and any output sink
    can append its rows.
    """
    q = parse(text)
    if not isinstance(q, Select) or q.modifier or q.order or q.limit is not None:
        raise ValueError("a streaming query is a plain SELECT")
    return Engine(store, sources={seed: stream}).select(q)


def match_streams(streams: dict[int, DataFrame], store: GraphStore, text: str, within: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Solutions of a query of which several patterns are met by streams (s, p, o, ts; by the pattern's number), the others by the store.

    Triples that meet lie no further apart than `within`, by their event times:
    Spark's stream-stream joins keep each side's triples only as long as a partner may still
    come. What is later than lateness is left out. Columns: the query's, and ts, the latest of the times.
    """
    q = parse(text)
    if not isinstance(q, Select) or q.modifier or q.order or q.limit is not None or q.where.optionals or q.where.unions or q.where.nested:
        raise ValueError("a query over streams is a plain SELECT of one group")
    engine = Engine(store)
    out, names = None, []
    for number in sorted(streams):
        mine = engine.scan(q.where.patterns[number], streams[number].withWatermark("ts", lateness), ("ts",))
        if out is None:
            out, names = mine.df.withColumnRenamed("ts", "__first").withColumn("__last", F.timestamp_micros(F.unix_micros("__first"))), list(mine.vars)  # one event time only
            continue
        shared = [v for v in names if v in mine.vars]
        if not shared:
            raise ValueError("patterns over streams share a variable with those before")
        theirs = mine.df.select(*[F.col(f"`{engine._name(v)}`").alias(f"r_{engine._name(v)}") for v in mine.vars], F.col("ts").alias("r_ts"))
        on = [F.col(f"`{engine._name(v)}`") == F.col(f"`r_{engine._name(v)}`") for v in shared]
        near = (F.col("r_ts") >= F.col("__first") - F.expr(f"INTERVAL {within}")) & (F.col("r_ts") <= F.col("__first") + F.expr(f"INTERVAL {within}"))
        joined = out.join(theirs, [*on, near])
        more = [v for v in mine.vars if v not in names]
        out = joined.select(*[F.col(f"`{engine._name(v)}`") for v in names], *[F.col(f"`r_{engine._name(v)}`").alias(engine._name(v)) for v in more], "__first", F.greatest("__last", "r_ts").alias("__last"))
        names += more
    rest = [p for i, p in enumerate(q.where.patterns) if i not in streams]
    if rest:
        static = engine.bgp(rest)
        shared = [v for v in names if v in static.vars]
        out = out.join(static.df, [engine._name(v) for v in shared]) if shared else out.crossJoin(static.df)
        names += [v for v in static.vars if v not in names]
    for e in q.where.filters:
        out = out.where(compile_filter(e, lambda v: engine._col(v) if v in names else None))
    return out.select(*[engine._col(v).alias(v) for v in q.columns()], F.col("__last").alias("ts"))


def predicate_rates(stream: DataFrame, window: str = "1 minute", lateness: str = "5 minutes") -> DataFrame:
    """Triples for each predicate and time window of a stream (s, p, o, ts); what is later than lateness is left out."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", window), "p").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "p", "n")
