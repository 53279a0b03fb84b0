"""Column expressions and distribution tails."""
