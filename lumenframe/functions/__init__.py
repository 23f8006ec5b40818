"""Part of the object-analytics library; see README.md."""
