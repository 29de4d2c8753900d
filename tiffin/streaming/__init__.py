"""Event feeds as Structured Streaming jobs, with batch twins where one exists."""
