"""Training-data operators on text; nothing else in the library imports this subpackage."""
