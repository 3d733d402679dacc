"""User-level operators (all DataFrame plans; no Python UDF)."""
