"""Requirements of whole postings, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fitgrid.functions import lines as L
from fitgrid.functions.options import lists_of
from fitgrid.operators import requirements as R

POSTING = """<h2>Data Engineer</h2><p>We are a bank that likes data and people who like them, and we go far together every day.</p>
<h3>Your tasks</h3><ul><li>Build pipelines in Python and SQL</li><li>Keep Kafka running</li></ul>
<h3>Requirements</h3><ul><li>5+ years of experience with Python</li><li>Bachelor's degree in anything</li><li>Fluent English and good German</li><li>Airflow, ideally on Kubernetes</li><li>You can teach Go and SQL</li><li>Leadership</li></ul>
<h3>Nice to have</h3><ul><li>Docker</li><li>Python</li></ul><h3>Benefits</h3><p>Health insurance, Spark evenings and a Java course</p>"""


def test_postings(spark):
    words = ["python", "sql", "kafka", "airflow", "kubernetes", "docker", "spark", "java", "go", "english", "crm"]
    vocabulary = spark.createDataFrame([(w, False) for w in words] + [("leadership", True), ("people", True)], "alias_norm string, weak boolean")
    rows = [(1, POSTING, ["x"]), (2, "Too short", ["Excel", " excel ", "Remote"]), (3, None, []), (4, "A long text that says nothing about any skill at all. " * 6, ["CRM", "Remote", "Nothing"])]
    got = {r["id"]: r for r in R.extracted(spark.createDataFrame(rows, "id int, description string, tags array<string>"), vocabulary).collect()}
    r = got[1]
    assert r["required"] == ["Python", "SQL", "Kafka", "Airflow", "Go", "Leadership"] and r["preferred"] == ["Kubernetes", "Docker"]
    assert (r["min_years"], r["education"], r["languages"], r["warnings"]) == (5, "bachelor", ["English", "German"], [])
    assert r["responsibilities"] == ["Build pipelines in Python and SQL", "Keep Kafka running"]
    assert (got[2]["required"], got[2]["languages"], got[2]["warnings"]) == (["Excel", "Remote"], None, ["tags_fallback"])
    assert (got[3]["required"], got[3]["warnings"]) == ([], ["tags_fallback", "no_requirements"])
    assert (got[4]["required"], got[4]["warnings"], got[4]["min_years"]) == (["CRM"], ["tags_added"], None)
    assert r["preferred_quotes"] == ["Airflow, ideally on Kubernetes", "Docker"] and r["required_quotes"][0] == "Build pipelines in Python and SQL"


WORDS = ["ml", "nlp", "cisco", "sql", "oracle", "linux", "windows", "python", "javascript", "aws", "azure", "gcp", "agile", "jira", "confluence", "leadership", "postgresql", "mysql", "microsoft excel", "google sheets", "react", "active directory", "crm", "data", "django"]
OPTIONS = [
    ("Basic knowledge in SQL, Oracle, Linux, or Windows", {"SQL": True, "Oracle": True, "Linux": True, "Windows": True}),
    ("PostgreSQL (or MySQL)", {"PostgreSQL": False, "MySQL": False}),
    ("Enhance front-end with Hotwire, StimulusJS, or React", {"React": False}),
    ("Experience with Azure AD, Active Directory, Intune, or other RMM agents", {"Azure": False, "Active Directory": False}),
    ("Navigate digital tools such as SLACK, CRM software, google sheets, etc.", {"CRM": False, "google sheets": False}),
    ("Experience integrating AI/ML models (e.g., LLMs, NLP) with web applications", {"ML": False, "NLP": True}),
    ("IT-related degree and/or certifications (Cisco, A+, Network+, Microsoft, or equivalent)", {"Cisco": True}),
    ("Code in Python and any one additional language (for example, JavaScript, AppScript)", {"Python": False, "JavaScript": True}),
    ("3+ years with any of the modern Cloud Services (AWS, Azure, or GCP)", {"AWS": True, "Azure": True, "GCP": True}),
    ("Experience working with Modern Agile tools (e.g. Jira, Confluence)", {"Agile": False, "Jira": True, "Confluence": True}),
    ("Experience with Google Sheets, Microsoft Excel, QuickBooks Online, and Google Workspace", {"Google Sheets": False, "Microsoft Excel": False}),
    ("Python/Django and data, ideally with SQL/NoSQL", {"Python": False, "Django": False, "SQL": True}),
]


def test_options_and_examples_are_not_asked_for(spark):
    vocabulary = spark.createDataFrame([(w, False) for w in WORDS], "alias_norm string, weak boolean")
    lines = spark.createDataFrame([(i, 0, t, False, "requirements") for i, (t, _) in enumerate(OPTIONS)], "id int, at int, text string, bullet boolean, section string")
    got = {i: {} for i in range(len(OPTIONS))}
    for r in R.skills(R.sentence_rows(lines), vocabulary).collect():
        got[r["id"]][r["skill"]] = r["preferred"]
        assert r["quote"] == OPTIONS[r["id"]][0]
    assert got == {i: found for i, (_, found) in enumerate(OPTIONS)}


def test_lists():
    assert [(s, e) for s, e, _ in lists_of("no list here, only commas")] == []
    (start, end, sure), = lists_of("Basic knowledge in SQL, Oracle, Linux, or Windows.")
    assert "Basic knowledge in SQL, Oracle, Linux, or Windows."[start:end] == "knowledge in SQL, Oracle, Linux, or Windows." and not sure
    text = "Tools (e.g. Jira; Git)"
    assert [text[s:e] for s, e, sure in lists_of(text) if sure] == [" Jira"]


@pytest.mark.parametrize("most", [64 << 20, -1])
def test_words_with_slashes(spark, monkeypatch, most):
    monkeypatch.setattr(L, "MOST_BYTES", most)
    rows = [(1, "AI/ML and SQL/Python/x"), (2, "ci/cd with C/C++"), (3, "SQL /Python a/b"), (4, "SQL/SQL")]
    vocabulary = spark.createDataFrame([(w, False) for w in ("ml", "sql", "python", "ci/cd", "ci", "c", "c++", "and sql/python/x now", "b")], "alias_norm string, weak boolean")
    got = {}
    for r in L.skill_hits(spark.createDataFrame(rows, "id int, text string"), ["id"], vocabulary).orderBy("place", "skill").collect():
        got.setdefault(r["id"], []).append((r["place"], r["skill"]))
    assert got == {1: [(1, "ML"), (3, "Python"), (3, "SQL")], 2: [(1, "ci/cd"), (3, "C"), (3, "C++")], 3: [(1, "SQL"), (2, "Python"), (3, "b")], 4: [(1, "SQL"), (1, "SQL")]}


def test_a_partial_vocabulary_is_said(spark):
    vocabulary = spark.createDataFrame([("python", False)], "alias_norm string, weak boolean")
    rows = spark.createDataFrame([(1, POSTING, []), (2, None, ["x"])], "id int, description string, tags array<string>")
    got = {r["id"]: r["warnings"] for r in R.extracted(rows, vocabulary, complete=False).select("id", F.col("warnings")).collect()}
    assert got == {1: ["partial_vocabulary"], 2: ["tags_fallback"]}
