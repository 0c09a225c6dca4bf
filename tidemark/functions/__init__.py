"""Column expressions and small vectorised numeric helpers."""
