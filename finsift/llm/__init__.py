"""Training-data operators: mixing, sharding, screening, deduplication and token
counts over document tables.  Nothing outside this subpackage imports it."""
