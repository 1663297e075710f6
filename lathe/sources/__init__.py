"""Sources: tables, delimited files, logs and documents."""
