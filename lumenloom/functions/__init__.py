"""Column helpers: patterns, maps, levels, one-line bodies, network addresses, times."""
