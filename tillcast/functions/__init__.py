"""Column-expression helpers (no UDFs): numeric cleaning, dates, statistics,
grid projection and text tagging."""
