"""``DataFrame -> DataFrame`` operators: dedup, batching, responses, samples, grids."""
