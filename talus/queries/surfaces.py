"""SQL text of the surfaces in talus.sources.tables, for checks in another engine."""

DENSE = "SELECT CAST(vec_id AS INTEGER) AS row, CAST(k - 1 AS INTEGER) AS col, 100 * CAST(embedding[k] AS DOUBLE) AS z FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)"

_CELLS = "SELECT CAST(floor(l_partkey / 20) AS INTEGER) AS row, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 30) AS INTEGER) AS col, l_extendedprice AS price, l_orderkey % 2 AS odd FROM lineitem"

SPARSE = f"SELECT row, col, avg(price) / 997 AS z, count(*) AS n FROM ({_CELLS}) GROUP BY row, col"

PAIR = f"SELECT * FROM (SELECT row, col, avg(price) FILTER (WHERE odd = 0) / 997 AS z_ref, avg(price) FILTER (WHERE odd = 1) / 997 AS z_tba FROM ({_CELLS}) GROUP BY row, col) WHERE z_ref IS NOT NULL AND z_tba IS NOT NULL"

SERIES = "SELECT date_trunc('year', l_shipdate) AS ts, CAST(floor(l_partkey / 20) AS INTEGER) AS row, CAST(floor((dayofyear(l_shipdate) - 1) / 30) AS INTEGER) AS col, avg(l_extendedprice) / 997 AS z FROM lineitem GROUP BY ALL"

POINTS = "SELECT event_id AS pid, CAST(user_id AS DOUBLE) AS x, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS y, value AS z FROM events"


def with_surface(name: str, text: str) -> str:
    return f"WITH {name} AS ({text})"
