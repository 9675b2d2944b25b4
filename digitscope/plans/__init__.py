"""End-to-end plans: extraction, preview and reports."""
