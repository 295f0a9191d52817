"""All registered queries: name to (query, SQL counterpart or None)."""

from vigilake.plans import catalog_queries, drift_queries, feed_queries, profile_queries, text_queries

REGISTRY = {
    **profile_queries.QUERIES,
    **drift_queries.QUERIES,
    **feed_queries.QUERIES,
    **text_queries.QUERIES,
    **catalog_queries.QUERIES,
}
