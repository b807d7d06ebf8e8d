"""Multi-row operators: hops, aggregations, loops."""
