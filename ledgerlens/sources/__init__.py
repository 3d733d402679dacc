"""Sources: JDBC (ERP / portal), hand-off CSVs, roster, Parquet, and the test-table mapping."""
