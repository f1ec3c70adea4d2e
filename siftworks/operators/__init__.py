"""DataFrame-level operators: joins, windows, graphs, search and upserts."""
