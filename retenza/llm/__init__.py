"""Operators for building training corpora: cleaning, deduplication,
decontamination, tokenisation, packing and sharding of documents."""
