"""Training-data operators; no other part of the library imports this subpackage."""
