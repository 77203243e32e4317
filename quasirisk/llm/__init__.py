"""Operators that prepare text for training language models.

Nothing else in the library imports this subpackage.  Conventions shared by all operators:
documents are rows of (doc_id, text, ...); a word is a run of characters other than space
and \\t \\n \\v \\f \\r; offsets count code points, ends are exclusive; NULL text is an empty
text; a NULL or repeated doc_id is a row like any other; other columns are ignored, or
carried where a function says so; empty tables give empty results.
"""
