"""Registered queries."""

from . import catalogue, funds, more, sheets, streams  # noqa: F401
