"""Files, fitted weights and embedding, on files made here."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrid.functions import embedding as V
from fitgrid.operators import comparison as C
from fitgrid.operators import learned as W
from fitgrid.operators import taxonomy as X
from fitgrid.operators.scoring import Weights
from fitgrid.sources import files


def test_esco_rows(spark, tmp_path):
    head = "conceptType,conceptUri,preferredLabel,altLabels,hiddenLabels,status,modifiedDate,description\n"
    k = "KnowledgeSkillCompetence"
    rows = [f'{k},u1,"Go (programming)","Golang\nGo language",,released,2020-01-01,"says ""go"", twice"', f"{k},u1,Go,,,released,2021-01-01,", f"{k},u1,Late,,,released,2021-01-01,", f"{k},u2,Old,,,obsolete,2022-01-01,", "SkillGroup,u3,Group,,,released,2022-01-01,"]
    (tmp_path / "s.csv").write_text("﻿" + head + "\n".join(rows) + "\n", encoding="utf-8")
    df = files.read_esco(spark, str(tmp_path / "s.csv"))
    got = {r["preferred"]: r for r in df.collect()}
    assert got["Go (programming)"]["alt"] == "Golang\nGo language" and got["Go (programming)"]["description"] == 'says "go", twice'
    kept = X.released(df, [F.col("pos")]).collect()
    assert [(r["uri"], r["preferred"]) for r in kept] == [("u1", "Go")]
    assert df.select(X.split_labels(F.col("alt")).alias("a")).first()["a"] == ["Golang", "Go language"]


def test_custom_rows_and_all_their_errors(spark):
    uri = "http://data.europa.eu/esco/skill/1"
    concepts = spark.createDataFrame([(uri, "SQL")], "canonical_id string, name_en string")
    good = [(1, files.CUSTOM + "dbt", "dbt", "data build tool", "en"), (2, files.CUSTOM + "dbt", "", "dbt core", "en"), (3, uri, "SQL", "ess queue ell", "en")]
    schema = "pos long, canonical_id string, canonical_name string, alias string, lang string"
    new, found, errors = files.custom_skills(spark.createDataFrame(good, schema), concepts)
    assert errors.count() == 0 and [(r["canonical_id"], r["name_en"], r["source"]) for r in new.collect()] == [(files.CUSTOM + "dbt", "dbt", "custom")]
    assert {(r["canonical_id"], r["alias_norm"]) for r in found.collect()} == {(files.CUSTOM + "dbt", "dbt"), (files.CUSTOM + "dbt", "data build tool"), (files.CUSTOM + "dbt", "dbt core"), (uri, "ess queue ell")}
    bad = [(1, files.CUSTOM + "a", "A", "x", "fr"), (2, files.CUSTOM + "A b", "A", "x", "en"), (3, files.CUSTOM + "c", "", "x", "en"), (4, files.CUSTOM + "d", "D", "", "en"), (5, files.CUSTOM + "d", "E", "", "en"), (6, "nothing", "", "x", "en"), (7, uri + "9", "", "x", "en"), (8, uri, "", "", "en"), (9, uri, "Sequel", "x", "en"), (10, uri, "", "D", "en")]
    errors = files.custom_skills(spark.createDataFrame(bad, schema), concepts)[2]
    assert {(r["pos"], r["problem"]) for r in errors.collect()} == {(1, "language"), (2, "slug"), (3, "name_missing"), (5, "name_conflict"), (6, "canonical_id"), (7, "unknown_uri"), (8, "alias_missing"), (9, "name_mismatch"), (None, "alias_conflict")}


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join("<w:p>" + "".join(f"<w:r><w:rPr>{'<w:b/>' if b else ''}</w:rPr><w:t>{t}</w:t></w:r>" for t, b in runs) + "</w:p>" for runs in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_documents_of_word_processors(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Experience", True)], [("", False)], [("Wrote ", False), ("SQL", True), (" for years", False)]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = files.docx_blocks(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path", "at").collect()
    assert [(r["path"][-6:], r["at"], r["text"], r["bold"], r["error"]) for r in got] == [("a.docx", 0, "Experience", True, None), ("a.docx", 1, "Wrote SQL for years", False, None), ("b.docx", None, None, None, "unreadable")]


def test_newest_usable_cache(spark):
    rows = [("/c/adzuna-20240101T000000Z.json", "{}"), ("/c/adzuna-20240301T000000Z.json", "broken"), ("/c/adzuna-20240201T000000Z.json", "{}"), ("/c/jooble-20250101T000000Z.json", "{}")]
    df = spark.createDataFrame(rows, "path string, body string")
    assert files.newest_cache(df, "adzuna", F.col("body") == "{}").first()["stamp"] == "20240201T000000Z"
    assert files.newest_cache(df, "remotive", F.lit(True)).count() == 0


def test_weights_and_fallback():
    scale = W.Calibration(0.7, 0.9, "m")
    text = W.weights_file(0.6, 3.0, 100, scale)
    assert W.selected("learned", text, scale) == (Weights(0.51, 0.34, 0.15), [])
    assert W.selected(None, text, scale) == W.selected("linear", None) == (Weights(), [])
    for wrong, code in ((None, W.MISSING), ("{", W.INVALID), (json.dumps(json.loads(text) | {"weights": {"skill": 2, "semantic": -1}}), W.INVALID), (json.dumps(json.loads(text) | {"ranking_version": "x"}), W.STALE_RANKING)):
        assert W.selected("learned", wrong, scale) == (Weights(), [code])
    assert W.selected("learned", text, W.Calibration(0.7, 0.8, "m"))[1] == [W.STALE_CALIBRATION] == W.selected("learned", text)[1]


@pytest.mark.parametrize("bad", [(-0.1, 0.9, 0.2), (0.5, 0.5, 0.5)])
def test_weights_are_checked(bad):
    with pytest.raises(ValueError):
        Weights(*bad)


def test_texts_are_embedded(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None] * 40)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", V.embedded(F.col("t"), lambda: V.hashed(16)).alias("v")).collect()}
    assert got[3] is None and got[0] == got[2] != got[1] and np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-5)
    assert V.unit_rows(np.zeros((1, 3))).tolist() == [[0, 0, 0]]


def plain_fit(x, y, ridge=1e-3):
    """Slope and loss of a logistic fit by many small steps of Newton's method on the rows themselves."""
    base = math.log(y.mean() / (1 - y.mean()))
    a, b = base, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + ridge * b])
        q = p * (1 - p)
        step = np.linalg.solve(np.array([[q.sum(), (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + ridge]]), g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    if b < 0:
        a, b = base, 0.0
    z = a + b * x
    return b, float((np.logaddexp(0, z) - y * z).sum())


@pytest.mark.parametrize("folds", [0, 3])
def test_weights_by_sums_are_those_of_the_rows(spark, folds):
    rng = np.random.default_rng(4)
    n = 300
    skill, semantic, fold = rng.random(n), rng.random(n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-6 * (0.7 * skill + 0.3 * semantic - 0.5)))).astype(int)
    rows = [(int(f), float(a), float(b), int(c)) for f, a, b, c in zip(fold, skill, semantic, y, strict=True)] + [(0, None, 0.5, 1), (1, 0.5, 0.5, None)]
    df = spark.createDataFrame(rows, "fold int, skill double, semantic double, label int").repartition(5)
    got = C.skill_weights(df, folds=folds)
    assert set(got) == (set(range(3)) if folds else {-1})
    for k, (w, slope, objective) in got.items():
        seen = fold != k
        fits = [plain_fit(v / 100 * skill[seen] + (1 - v / 100) * semantic[seen], y[seen]) for v in range(101)]
        objectives = [loss + C.PRIOR_STRENGTH * (v / 100 - C.PRIOR_SKILL) ** 2 for v, (_, loss) in enumerate(fits)]
        assert objective == pytest.approx(min(objectives), abs=1e-6) and objectives[round(w * 100)] == pytest.approx(min(objectives), abs=1e-6)
        assert slope == pytest.approx(fits[round(w * 100)][0], abs=1e-5)


def cards_of(spark, sessions, truth, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        for v in range(12):
            a, b = float(rng.random()), float(rng.random())
            rows.append((f"s{s}", v, None, int(truth(a, b) > 0.6), a, b))
    return spark.createDataFrame(rows, "session string, vacancy_id long, band_rank int, label int, skill double, semantic double")


def test_scorers_are_compared_over_folds(spark):
    got = C.compared_scorers(cards_of(spark, 60, lambda a, b: b)).first()
    assert got["verdict"] == "learned_better" and got["low"] > 0 and got["learned"] > got["linear"] and got["wins"] > got["losses"]
    assert got["folds"] == 5 and len(got["weights"]) == 5 and max(got["weights"]) < 0.3 and got["learned_spearman"] > got["linear_spearman"]
    few = C.compared_scorers(cards_of(spark, 19, lambda a, b: b)).first()
    assert few["sessions"] <= 19 and few["verdict"] == "inconclusive" and few["low"] is not None
    fixed = C.compared_scorers(cards_of(spark, 40, lambda a, b: C.PRIOR_SKILL * a + (1 - C.PRIOR_SKILL) * b), strength=1e6).first()
    assert (fixed["wins"], fixed["losses"], fixed["verdict"]) == (0, 0, "inconclusive") and fixed["ties"] == fixed["sessions"]
    none = C.compared_scorers(cards_of(spark, 30, lambda a, b: 0)).first()  # no useful card: no fold can be fitted
    assert (none["sessions"], none["skipped_folds"], none["skipped_sessions"], none["verdict"]) == (0, 5, 30, "inconclusive")
