"""Training-data operators: URL filtering, deduplication, packing, scans, models, search and token files.

Nothing outside this folder imports it; remove the folder and the rest of the library stays whole.
"""
