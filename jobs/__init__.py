"""Runnable jobs on the library's operators: `python -m jobs.notes_profile --help`, `python -m jobs.clearance --help`."""
