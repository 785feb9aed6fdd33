"""User-level jobs (jobs.py) and the registered driver queries (registry.py)."""
