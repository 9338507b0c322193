"""Part of tempestry; see README.md."""
