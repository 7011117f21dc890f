"""Sources and sinks: reference sets, payload banks, cell stores, synthetic requests, derived fixtures."""
