"""Reading indexes, pages, tables and dimensions; writing results."""
