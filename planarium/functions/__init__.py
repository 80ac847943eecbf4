"""Column functions: no joins, no shuffles, all inside whole-stage code generation."""
