"""Functions of the engine; see README.md for the map."""
