"""Pieces of comparison SQL that several queries share."""

from __future__ import annotations


def norm(path: str) -> str:
    """One spelling of a path: trimmed, slashes only, without empty, ``.`` and ``..`` steps."""
    slashes = rf"replace(regexp_replace({path}, '^\s+|\s+$', '', 'g'), '\', '/')"
    return rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({slashes}, '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '[^/]+/\.\./', '', 'g'), '^/|/$', '', 'g')"""
