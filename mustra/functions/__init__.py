"""Column functions of the cohort engine."""
