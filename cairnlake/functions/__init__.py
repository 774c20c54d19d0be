"""Scalar functions: hashes, codecs, parsers and path predicates."""
