"""Training-data operators: de-duplication, filtering, tokenising, packing, archives.

Nothing else in the library imports this subpackage; removing it leaves the
table explorer intact.
"""
