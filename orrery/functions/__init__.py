"""Part of the orrery engine; see README.md."""
