"""Operators for training data: text forms, copies, frequencies, mapping, packing, mixing and personal information."""
