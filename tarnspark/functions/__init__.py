"""Column functions: scaling and rounding, the request vectoriser, quantisation and distances."""
