"""Reading server logs and catalogs, writing and retiring repository tables."""
