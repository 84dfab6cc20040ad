"""Column functions: text keys, rule tables, URLs, salaries."""
