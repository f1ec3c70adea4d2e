"""Column-level functions: every one maps Columns to Columns and stays inside codegen."""
