"""Reading cohort tables and writing results."""
