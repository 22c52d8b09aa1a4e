"""Readers and writers: registry text files, the snapshot fact table, the code glossary."""

from periodica.sources.dictionary import build_codes, read_codes, refresh_codes, rows_with_codes
from periodica.sources.facts import copy_facts, read_facts, replace_period, replace_periods, write_facts
from periodica.sources.glossary import empty_glossary, read_glossary
from periodica.sources.quarantine import TooManyRejected, read_registry_files, set_aside
from periodica.sources.registry import canonical_columns, canonicalize, read_registry

__all__ = [
    "TooManyRejected",
    "build_codes",
    "canonical_columns",
    "canonicalize",
    "copy_facts",
    "empty_glossary",
    "read_codes",
    "read_facts",
    "read_glossary",
    "read_registry",
    "read_registry_files",
    "refresh_codes",
    "replace_period",
    "replace_periods",
    "rows_with_codes",
    "set_aside",
    "write_facts",
]
