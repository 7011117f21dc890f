"""The query catalogue and its DuckDB SQL."""
