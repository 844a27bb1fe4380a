"""Column expressions: vectors, text, codes, hashes.  No Python UDFs in here."""
