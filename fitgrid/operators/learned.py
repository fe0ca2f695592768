"""Fitted weights: their file, when it is stale, and which weights a ranking uses."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from .scoring import W_EXPERIENCE, Weights

# The file's format, the ranking's version, and codes of a file that cannot be used.
FORMAT, RANKING = 1, "fit-1"
MISSING, INVALID, STALE_RANKING, STALE_CALIBRATION = "weights_missing", "weights_invalid", "weights_stale_ranking", "weights_stale_calibration"
UNCALIBRATED = "uncalibrated"


@dataclass(frozen=True)
class Calibration:
    floor: float
    ceil: float
    embedding_version: str


def fingerprint(calibration: Calibration | None) -> str:
    """A short fingerprint of the scale that semantic scores are on."""
    if calibration is None:
        return UNCALIBRATED
    text = json.dumps({"floor": calibration.floor, "ceil": calibration.ceil, "embedding_version": calibration.embedding_version}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def weights_of(skill: float) -> Weights:
    """The weights of a fitted split of skill and semantic; years keep their fixed share."""
    rest = 1 - W_EXPERIENCE
    return Weights(round(skill * rest, 4), round(rest - round(skill * rest, 4), 4), W_EXPERIENCE)


def weights_file(skill: float, slope: float, rows: int, calibration: Calibration | None = None) -> str:
    return json.dumps({"format_version": FORMAT, "weights": {"skill": skill, "semantic": round(1 - skill, 2)}, "slope": slope, "n_rows": rows, "ranking_version": RANKING, "calibration_fingerprint": fingerprint(calibration)}, indent=2)


def read_weights(text: str | None, calibration: Calibration | None = None) -> tuple[Weights | None, str | None]:
    """The weights of a file, or why it cannot be used."""
    if text is None:
        return None, MISSING
    try:
        found = json.loads(text)
        skill, semantic = (found["weights"][k] for k in ("skill", "semantic"))
        if found["format_version"] != FORMAT or isinstance(skill, bool) or not 0 <= skill <= 1 or abs(skill + semantic - 1) > 1e-9:
            return None, INVALID
        if found["ranking_version"] != RANKING:
            return None, STALE_RANKING
        if found["calibration_fingerprint"] != fingerprint(calibration):
            return None, STALE_CALIBRATION
        return weights_of(float(skill)), None
    except (ValueError, KeyError, TypeError):
        return None, INVALID


def selected(flag: str | None, text: str | None, calibration: Calibration | None = None) -> tuple[Weights, list[str]]:
    """The weights that ``flag`` asks for (learned, else the fixed ones), falling back with a code."""
    if (flag or "linear").strip().lower() != "learned":
        return Weights(), []
    found, why = read_weights(text, calibration)
    return (found, []) if found else (Weights(), [why])
