"""Table operators: profile, drift, quality, steps, filters, joins, retrieval."""
