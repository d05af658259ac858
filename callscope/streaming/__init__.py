"""The dataflow over streams."""
