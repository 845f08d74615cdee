"""Training-data operators: scans, classifiers, packing, tokens, sharding, near-duplicates, media.

Nothing outside this folder imports it.  ``queries`` holds what is registered.
"""
