"""Column functions. Each takes and returns Columns, so it stays inside whole-stage codegen."""
