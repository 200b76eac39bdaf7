"""Column expressions over arrays and statistical distributions."""
