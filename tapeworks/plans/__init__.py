"""Registered queries, by area; importing the package registers them all."""

from . import analytics, bars, features, joins, sessions, signals, simulation, stores, streams, validation  # noqa: F401
