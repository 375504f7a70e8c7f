"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from assertlake.plans import curation, evaluation, inventory, module_queries, order_queries, pool_queries, request_queries, text_queries

QUERIES = {**curation.QUERIES, **evaluation.QUERIES, **text_queries.QUERIES, **module_queries.QUERIES, **request_queries.QUERIES, **order_queries.QUERIES, **pool_queries.QUERIES, **inventory.QUERIES}
ORACLE_SQL = {**curation.ORACLE_SQL, **evaluation.ORACLE_SQL, **text_queries.ORACLE_SQL, **module_queries.ORACLE_SQL, **request_queries.ORACLE_SQL, **order_queries.ORACLE_SQL, **pool_queries.ORACLE_SQL, **inventory.ORACLE_SQL}
