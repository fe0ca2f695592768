"""Likeness, places of quotes and pairs of names: cases by hand, and plain loops over all of them."""

import numpy as np
import pytest

from fitgrid.functions import fuzzy
from fitgrid.operators import fuzzy_pairs, grounding
from fitgrid.shared import saved


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = list(row)
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def like(a, b):
    return 200.0 * common(a, b) / (len(a) + len(b))


def test_common_subsequences():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abcd "), int(rng.integers(0, 90)))) for _ in "ab")
        assert fuzzy.Pattern(a).common(b) == common(a, b)
    assert fuzzy.ratio("", "") == 100.0 and fuzzy.ratio("a", "") == 0.0


def test_sets_of_words():
    assert fuzzy.token_set_ratio("data engineer", "senior data engineer") == 100.0
    assert fuzzy.token_set_ratio("", "a") == 0.0
    assert fuzzy.token_set_ratio("kyiv", "lviv") == 50.0
    # words shared: 4 of 4 + 5 characters; both with their rests: 4 + 1 + 4 and 4 + 1 + 4 with two in common
    assert fuzzy.token_set_ratio("data abcd", "data abxy") == pytest.approx(max(100 * (1 - 4 / 18), 100 * 8 / 13))


def every_window(needle, text, least):
    m, n, best = len(needle), len(text), None
    if not m or m > n:
        return None
    for lo, hi in [*((0, k) for k in range(1, m)), *((s, s + m) for s in range(n - m + 1)), *((n - k, n) for k in range(m - 1, 0, -1))]:
        s = like(needle, text[lo:hi])
        if s >= least and (best is None or s > best[0]):
            best = (s, lo, hi)
    return best


def test_the_window_most_like_a_quote():
    rng = np.random.default_rng(1)
    found = 0
    for turn in range(400):
        letters = list("abcdef ") if turn % 2 else list("ab ")
        text = "".join(rng.choice(letters, int(rng.integers(12, 90))))
        m = int(rng.integers(12, max(13, len(text))))
        at = int(rng.integers(0, max(1, len(text) - m)))
        needle = list(text[at : at + m])
        for _ in range(int(rng.integers(0, 4))):
            i = int(rng.integers(0, len(needle)))
            if rng.random() < 0.5:
                needle.pop(i)
            else:
                needle.insert(i, str(rng.choice(letters)))
        needle = "".join(needle)
        want, got = every_window(needle, text, 90.0), fuzzy.best_window(needle, text, 90.0)
        assert (got is None) == (want is None)
        if want:
            found += 1
            assert got[0] == pytest.approx(want[0]) and like(needle, text[got[1] : got[2]]) == pytest.approx(want[0])
    assert found > 100


def test_plain_texts_and_their_places():
    text = "Soft­ware  develop-\nment, Front-\nEnd 2019-\n2021 “quo​ted” ﬁne й\n\n"
    plain, places = fuzzy.plain_with_places(text)
    assert plain == 'Software development, Front-End 2019-2021 "quoted" fine й '
    assert len(plain) == len(places) and places == sorted(places)
    whole = grounding.Text(text)
    for word, span in (("Software", "Soft\u00adware"), ("development", "develop-\nment"), ("\u0439", "\u0438\u0306"), ("fine ", "\ufb01ne")):
        at = plain.index(word)
        assert text[slice(*whole.back(at, at + len(word)))] == span
    assert fuzzy.plain_with_places("") == ("", [])


def test_quotes():
    cv = "Summary\nBuilt data pipe-\nlines in Python.\nSkills\nPython, SQL, “Airflow”\nExperience\nRan Python jobs on a large cluster of machines."
    t = grounding.Text(cv)
    assert t.find("Built data")[:3] == ("exact", 8, 18)
    status, lo, hi, *_ = t.find("data pipelines in Python, S")
    assert status == "fuzzy" and cv[lo:hi].startswith("data pipe-\nlines in Python")
    status, lo, hi, score, several = t.find("data pipelines  in\nPython")
    assert (status, cv[lo:hi], score, several) == ("normalized", "data pipe-\nlines in Python", None, False)
    assert t.find('"Airflow"')[0] == "normalized" and t.find("<section type='skills'>SQL</section>")[:1] == ("exact",)
    assert t.find("Ran Pyton jobs on a large clustr")[0] == "fuzzy" and t.find("Pyhton") == ("ungrounded", None, None, None, False)
    assert t.find("")[0] == t.find("   ")[0] == t.find("nothing of this is in the text")[0] == "ungrounded"
    # three places: the one in the expected section, else the first, which is marked
    assert t.find("Python")[-1] is True
    at = cv.index("Skills\n")
    t = grounding.Text(cv, [({"skills"}, at + 7, cv.index("Experience"))])
    assert t.find("Python", {"skills"}) == ("exact", at + 7, at + 13, None, False)
    assert t.find("Python", {"education"})[1:] == (cv.index("Python"), cv.index("Python") + 6, None, True)


def test_grounded_rows(spark, monkeypatch):
    monkeypatch.setattr(grounding, "QUOTES", 2)
    cv = "Name Nameson\nPython and SQL\nwrote Python code for three years at a bank"
    masked = cv.replace("Nameson", "███████")
    texts = spark.createDataFrame([(1, cv, masked), (2, None, None), (3, cv, "short"), (4, "", "")], "doc_id long, text string, searched string")
    quotes = spark.createDataFrame([(1, "skills[0]", "Python", "skills_list"), (1, "a", "Nameson", None), (1, "b", "███████", None), (1, "c", "wrote Pyton code for three years", None), (1, "d", None, None), (2, "a", "x", None), (3, "a", "Nameson", None), (4, "a", "", None), (9, "a", "no text at all", None)], "doc_id long, path string, quote string, found_in string")
    cut = spark.createDataFrame([(1, ["skills"], 13, 28)], "doc_id long, types array<string>, content_start long, end long")
    got = {(r["doc_id"], r["path"]): (r["status"], r["start"], r["matched"], r["ambiguous"], r["low_confidence"]) for r in grounding.grounded(texts, quotes, cut).collect()}
    assert got == {
        (1, "skills[0]"): ("exact", 13, "Python", False, False),
        (1, "a"): ("ungrounded", None, None, False, True),
        (1, "b"): ("exact", 5, "Nameson", False, False),
        (1, "c"): ("fuzzy", 28, "wrote Python code for three year", False, True),
        (2, "a"): ("ungrounded", None, None, False, True),
        (3, "a"): ("exact", 5, "Nameson", False, False),
        (4, "a"): ("ungrounded", None, None, False, True),
        (9, "a"): ("ungrounded", None, None, False, True),
    }


def greedy(gold, predicted):
    pairs = sorted((-fuzzy.token_set_ratio(a, b), g, p) for g, a in enumerate(gold) for p, b in enumerate(predicted) if fuzzy.token_set_ratio(a, b) >= 85)
    used_g, used_p = set(), set()
    for _, g, p in pairs:
        if g not in used_g and p not in used_p:
            used_g.add(g)
            used_p.add(p)
    return len(used_g)


def test_pairs_one_to_one(spark):
    rng = np.random.default_rng(6)
    words = ["data", "date", "engineer", "enginer", "senior", "lead", "a", "ab", "abc", "of", "analyst", "analysts"]
    gold, predicted, want = [], [], {}
    for group in range(25):
        sides = [[" ".join(rng.choice(words, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(0, 9)))] for _ in "gp"]
        gold += [(group, i, t) for i, t in enumerate(sides[0])]
        predicted += [(group, i, t.upper() if i % 2 else t) for i, t in enumerate(sides[1])]
        g, p = (list(dict.fromkeys(s)) for s in sides)
        if g or p:
            tp = greedy(g, p)
            want[group] = (tp, len(p) - tp, len(g) - tp)
    gold += [(99, 0, " ... "), (99, 1, None), (98, 0, "only gold")]
    want[98] = (0, 0, 1)
    schema = "grp long, pos long, text string"
    got = fuzzy_pairs.pair_counts(spark.createDataFrame(gold, schema), spark.createDataFrame(predicted, schema), "grp")
    assert {r["grp"]: (r["tp"], r["fp"], r["fn"]) for r in got.collect()} == want
    with pytest.raises(ValueError):
        fuzzy_pairs.alike(None, None, "grp", 60.0)


def test_name_pairs_are_not_broadcast(spark, capsys):
    rows = [("a", i, f"word{i} of text {i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "grp string, pos long, text string")
    keys = saved(fuzzy_pairs.distinct_keys(df, "grp", "pos", "text"), "keys")
    pairs = fuzzy_pairs.alike(keys, keys, "grp")
    pairs.explain()
    assert "BroadcastExchange" not in capsys.readouterr().out
    assert pairs.filter("g = p AND score = 100").count() == 40 and pairs.count() == pairs.distinct().count()
