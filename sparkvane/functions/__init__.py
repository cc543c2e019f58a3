"""Column expressions: binary16 rounding and vector arithmetic."""
