"""DataFrame-to-DataFrame operators, partitioned by entity keys."""
