"""Column expressions: time, text, buckets, geodesy, asset physics, business terms."""
