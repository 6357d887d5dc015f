"""Where the plans register their queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: The samples of all blocks in long form.
PX = "px AS (SELECT vec_id AS block, label::BIGINT AS stream_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i FROM embeddings)"
#: Left and right of neighbouring blocks in long form.
STEREO = f"{PX}, st AS (SELECT a.block // 2 AS pair, a.i, a.x AS l, b.x AS r FROM px a JOIN px b ON b.block = a.block + 1 AND b.i = a.i WHERE a.block % 2 = 0)"
#: Clips of 18 blocks, 1152 samples, zero where blocks are missing.
CLIPS = f"{PX}, cl AS (SELECT c.clip, c.n, coalesce(x, 0.0) AS x FROM (SELECT clip, unnest(range(1152)) AS n FROM (SELECT DISTINCT block // 18 AS clip FROM px)) c LEFT JOIN px ON px.block = c.clip * 18 + c.n // 64 AND px.i = c.n % 64)"
#: The signal of each user's events.
EVENT_SIGNAL = "ev AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS i, value / 500.0::DOUBLE AS x FROM events WHERE user_id IS NOT NULL)"
#: Lines of an order as frames of a stream.
FRAMES = "fr AS (SELECT l_orderkey AS stream_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1)::BIGINT AS frame, (l_quantity * 8)::BIGINT AS payload, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"


def rounded(column: str, digits: int = 6) -> str:
    """Rounding without a negative zero."""
    return f"round({column}, {digits}) + 0.0::DOUBLE"
