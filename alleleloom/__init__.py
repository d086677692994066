"""Allele-aligned scoring, cohort statistics and plan search as Spark jobs."""
