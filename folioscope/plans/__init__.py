"""Queries over the driver's tables, one module for each subsystem."""

from folioscope.plans import catalogue, citations, files, harvest, maintenance, maps, records, rules, upkeep, web  # noqa: F401
