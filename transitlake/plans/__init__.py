"""Reports, dashboard tables and quality checks."""
