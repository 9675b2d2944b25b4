"""DataFrame operators: distributions, ranks, samples, lookups and grouping."""
