"""Operators over relations of boxes, windows, runs of pixels and logs."""
