"""Column expressions: no UDFs, everything stays inside whole-stage codegen."""
