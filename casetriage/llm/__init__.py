"""Training-data operators: scoring, search, joins, scans, encoding, archives, sharding."""
