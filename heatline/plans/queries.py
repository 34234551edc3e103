
from __future__ import annotations

from heatline.plans import landed_queries, misc_queries, news_queries, refresh_queries, term_queries, traffic_queries

_PARTS = (traffic_queries, news_queries, term_queries, landed_queries, misc_queries, refresh_queries)


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in _PARTS for k, q in p.O.items()}
