"""DataFrame-to-DataFrame operators: splits, sampling, joins, metrics, clean-up."""
