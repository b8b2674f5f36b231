"""DataFrame-level operators: lookups, spatial joins, ranks, quantiles, scores."""
