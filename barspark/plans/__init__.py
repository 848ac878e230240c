"""Compositions: detection runs, evaluation, and the registered queries."""
