"""Column functions: everything here maps Columns to Columns, one row at a time."""
