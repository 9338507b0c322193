"""Operators on training texts: leaks of evaluation items, mixing by target shares, long shared spans."""
