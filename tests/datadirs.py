"""Folders of the given tables (a module of its own: ``conftest`` is not a name to import from)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
