"""Column expressions over bases and k-mers."""
