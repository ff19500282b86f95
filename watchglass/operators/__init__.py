"""DataFrame -> DataFrame operators: matching, correlation, joins, analytics."""
