"""Fixed rule tables: expected distribution, domains, categories, units."""
