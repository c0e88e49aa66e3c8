"""Column expressions and small numeric routines."""
