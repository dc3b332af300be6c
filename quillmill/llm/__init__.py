"""Operators that prepare training text: matching, merging, labelling, packing and mixing."""
