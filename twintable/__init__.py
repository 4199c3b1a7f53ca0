"""Profile, clean, synthesise and compare flat tables on Spark."""
