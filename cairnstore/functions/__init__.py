"""Scalar and Arrow functions of the blob store: chunking, hashing, parsing, sealing."""
