"""Operators for preparing training corpora; nothing else in fitgrid imports this subpackage."""
