"""Training-data operators over the text of captured pages. Nothing else in the library imports this subpackage."""
