"""All queries of the engine by name, with the SQL that each must agree with."""

from __future__ import annotations

from .plans import checks, comparison, evaluation, extraction, feeds, layout, matching, profiles, ranking, records, search, taxonomy, texts, understanding

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _area in (ranking, records, evaluation, texts, understanding, taxonomy, profiles, comparison, checks, matching, feeds, layout, extraction, search):
    QUERIES |= _area.QUERIES
    ORACLES |= _area.ORACLES
FLAGSHIP = "fit_ranking"
