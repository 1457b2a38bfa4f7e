"""Chunkers: texts to rows.  A token is a code point; a chunk's id is its document's id and its order."""
