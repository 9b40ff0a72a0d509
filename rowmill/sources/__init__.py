"""Reading, combining, locating and writing tables."""
