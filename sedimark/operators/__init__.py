"""Operators from blobs to facts: dispatch, signatures, firmware, objects, differences."""
