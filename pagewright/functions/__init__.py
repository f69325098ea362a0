"""Column -> Column expressions. Nothing here triggers a job or a shuffle."""
