"""DataFrame operators: filters, joins, aggregations and expansions over fleet tables."""
