"""Training-data preparation operators: cleaning, tokenisation, packing and
deduplication of a document corpus. Nothing else in the package imports this
subpackage, so it can be removed as a whole."""
