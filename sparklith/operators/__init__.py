"""Table-level operators: positions, partitions, joins, prefix sums."""
