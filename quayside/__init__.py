"""Data onboarding, migration rehearsal and data-quality operators as Spark jobs."""
