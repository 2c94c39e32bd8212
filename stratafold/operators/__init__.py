"""DataFrame -> DataFrame operators. Rows are identified by explicit key columns, never by position."""
