"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; deleting it leaves the rest of the
library working.
"""
