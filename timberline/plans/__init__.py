"""How operators are put together into whole runs."""
