"""Column functions: text, addresses, string similarities."""
