"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; removing the folder leaves the rest
of the library whole.  ``queries.py`` holds the thin ``opN_<name>`` queries.
"""
