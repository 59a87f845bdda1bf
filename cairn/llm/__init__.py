"""Training-data operators: media, deduplication, decontamination, archives,
personal data, packing, token files and quality.

Nothing outside this subpackage imports it.
"""
