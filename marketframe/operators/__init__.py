"""DataFrame operators: shaping, selection, joins, metrics, time series, validation, registry."""
