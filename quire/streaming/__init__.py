"""The same steps as incremental jobs."""
