"""Operators for preparing training text: search for leaks, copies, secrets,
personal data and toxic passages, text extraction, token files and packing.

Nothing else in the library imports this subpackage.
"""
