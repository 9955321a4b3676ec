"""Key order, predicate expressions, hashes and the binary codec."""
