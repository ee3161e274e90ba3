"""Rule tables: plain data, replaceable by the caller."""
