"""Training-data operators over text tables. Nothing outside this subpackage imports it."""
