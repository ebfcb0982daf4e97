"""Training-data operators: decontamination, language id, scoring, sharding, scanning, packing.

Nothing outside this subpackage imports it.
"""
