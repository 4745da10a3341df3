"""Column-level building blocks: every function here returns a Column (or a
dict of Columns keyed by label) made only of built-in Spark expressions, so
it stays inside whole-stage codegen."""
