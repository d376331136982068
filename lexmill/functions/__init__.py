"""Column -> Column building blocks; nothing in here starts a job."""
