"""Where documents come from and where tables, logs and landed files go."""
