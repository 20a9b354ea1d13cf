"""Training-data operators: packing, privacy, language-model scores, token files, mixing, archives, quality.

Nothing else in the package imports this subpackage.
"""
