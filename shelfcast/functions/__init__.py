"""Column functions: cleaning rules, calendar parts, guarded ratios."""
