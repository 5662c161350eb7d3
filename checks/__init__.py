"""Queries over the driver tables, each beside independent SQL that gives the same rows."""
