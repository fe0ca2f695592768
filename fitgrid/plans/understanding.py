"""Places, requirements, contacts, wording and tracked alerts over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import requirements as Q
from ..functions import wording as V
from ..operators import alerts as A
from .ranking import _t


def _choice(values: tuple[str, ...], by):
    return F.element_at(F.array(*map(F.lit, values)), (F.lit(by) % len(values) + 1).cast("int"))


def _location(spark, sf_dir):
    """Where customers are: their nation by name, a state, a code or a city, alone or several, in three ways of writing."""
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    k = F.col("c_custkey")
    first = F.when(k % 7 < 3, F.initcap("n_name")).when(k % 7 < 5, _choice(STATES, F.floor(k / 7))).otherwise(_choice(CODES, F.floor(k / 7)))
    second = F.when(k % 4 == 0, _choice(STATES, F.floor(k / 11))).when(k % 4 == 1, F.initcap("c_mktsegment")).when(k % 4 == 2, F.upper("n_name")).otherwise("")
    return c.select("c_custkey", F.concat(first, _choice((", ", " / ", " (", " - "), F.floor(k / 3)), second).alias("place"))


STATES = ("California", "Texas", "Ontario", "Georgia", "New York", "Quebec", "Nowhere", "Washington")
CODES = ("DE", "CA", "TX", "GA", "ON", "uk", "USA", "ES", "ZZ")


def customer_places(spark, sf_dir):
    return _location(spark, sf_dir).select("c_custkey", P.resolve_country(F.col("place")).alias("code"))


def remote_limits(spark, sf_dir):
    """Countries that remote customers are limited to, from regions and places; unknown parts leave it open."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("Remote, "), _choice(REGIONS, k), F.when(k % 3 == 0, F.concat(F.lit("; "), _choice(REGIONS, F.floor(k / 3)))).otherwise(F.lit(" only")))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(P.allowed_countries(text), " ").alias("allowed"))


REGIONS = ("Europe", "EU", "LATAM", "North America", "Germany", "APAC", "Atlantis", "Worldwide", "Texas", "EMEA", "Poland")


def document_sentences(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(Q.sentences(F.coalesce("text", F.lit("")))).alias("n_sentences"))


def _sentences(spark, sf_dir):
    """A sentence an order, of an ask, a number, a degree, languages and a cue that its key, priority and status choose."""
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = F.when(k % 3 == 0, _choice(Q.NUMBERS, F.floor(k / 3))).otherwise((k % 23).cast("string"))
    years = F.concat(number, _choice(SPANS, F.floor(k / 7)), _choice((" years", " yrs", " year", " Jahre"), F.floor(k / 5)))
    degree = _choice(tuple(p for ps in Q.LEVELS.values() for p in ps if p.isascii()) + Q.NOT_ASKED[:4] + ("",) * 6, F.floor(k / 2))
    tongue = F.concat(_choice(PROFICIENT, F.floor(k / 11)), F.lit(" "), _choice(TONGUES, k), F.lit(" and "), _choice(TONGUES, F.floor(k / 13)))
    cue = _choice((*Q.PREFERRED[:14], "a big plus", "5 plus", "ideally first", "regardless of age", "paid time off", "ability to lead") + ("",) * 8, F.floor(k / 17))
    return o.select("o_orderkey", F.concat_ws(" ", F.lit("We ask"), years, F.lit("of work, a"), degree, F.lit("in"), "o_orderpriority", F.lit(";"), tongue, F.lit(","), cue).alias("text"))


SPANS = ("", "+", " plus", " - 12", "-12", " to 15", "–9 +")
PROFICIENT = ("fluent", "good", "any", "spoken", "C1", "the", "native")
TONGUES = ("English", "German", "polish", "Polish", "Spanish", "french", "Turkish", "Elvish", "Dutch")


def sentence_years(spark, sf_dir):
    return _sentences(spark, sf_dir).select("o_orderkey", F.array_join(Q.years_in(F.col("text")).cast("array<string>"), ",").alias("years"))


def sentence_degrees(spark, sf_dir):
    return _sentences(spark, sf_dir).select("o_orderkey", Q.education_in(F.col("text")).alias("level"))


def sentence_languages(spark, sf_dir):
    return _sentences(spark, sf_dir).select("o_orderkey", F.array_join(F.array_sort(Q.languages_in(F.col("text"))), ",").alias("languages"))


def sentence_cues(spark, sf_dir):
    t = F.col("text")
    return _sentences(spark, sf_dir).select("o_orderkey", Q.is_preferred(t).alias("preferred"), Q.preferred_from(t).alias("preferred_from"), Q.is_boilerplate(t).alias("boilerplate"), Q.asks(t).alias("asks"))


HEADS = tuple(p for ps in Q.SECTIONS.values() for p in ps)


def heading_sections(spark, sf_dir):
    """Sections of headings made of parts' names and of phrases, two of them in every third."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(F.when(k % 5 < 2, F.concat(F.initcap("p_name"), F.lit(" "))).otherwise(""), F.initcap(_choice(HEADS, k)), F.when(k % 3 == 0, F.concat(F.lit(" & "), _choice((*HEADS, "Required"), F.floor(k / 3)))).otherwise(""), F.lit(":"))
    return p.select("p_partkey", Q.heading_section(F.when(k % 11 == 0, F.col("p_name")).otherwise(text)).alias("section"))


def posting_modes(spark, sf_dir):
    """Work modes of postings whose head, text, flag and country an order's columns choose."""
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    remote = F.when(k % 5 == 0, True).when(k % 5 == 1, False)
    return o.select("o_orderkey", Q.work_mode(F.concat_ws(" ", "o_orderpriority", _choice(HEAD_WORDS, k)), _choice(TEXT_WORDS, F.floor(k / 6)), remote, F.when(F.col("o_orderstatus") == "F", "DE")).alias("mode"))


HEAD_WORDS = ("hybrid", "(remote)", "", "no remote", "hybrid remotely", "on-site only", "Kyiv")
TEXT_WORDS = ("", "fully remote team", "we work from home", "relocation support", "hybrid office", "remote is not possible", "must live in town", "remote control cars", "100% remote")


def masked_contacts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", V.mask_contacts(F.col("text")).alias("m"))
    return d.select("doc_id", "m.n_masked", (F.length("m.masked") == F.length("text")).alias("same_length"))


def required_wording(spark, sf_dir):
    """Lines of an order as required skills, those returned as had."""
    ln = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("have"), F.count("*").alias("total"))
    return ln.select("l_orderkey", V.required_sentence(F.col("have"), F.col("total")).alias("sentence"), V.required_short(F.col("have"), F.col("total")).alias("short"))


def balance_sign_test(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return A.sign_test(c, "c_nationkey", "c_acctbal").select("c_nationkey", "n", "positive", F.round("p", 6).alias("p"))


def balance_intervals(spark, sf_dir):
    return A.bootstrap_mean(_t(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal")


def tracked_alerts(spark, sf_dir):
    """Days are cycles; an event type with a value over 50 in a day is in alarm, over 100 critically."""
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "value")
    per = e.groupBy("code", "day").agg(F.max("value").alias("top"))
    severity = F.when(F.col("top") > 100, "critical").when(F.col("top") > 50, "warning")
    return A.tracked(per.select("code", F.unix_timestamp("day").cast("double").alias("now"), severity.alias("severity"), F.lit(True).alias("delivered")))


QUERIES = {f.__name__: f for f in (customer_places, remote_limits, document_sentences, sentence_years, sentence_degrees, sentence_languages, sentence_cues, heading_sections, posting_modes, masked_contacts, required_wording, balance_sign_test, balance_intervals, tracked_alerts)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _pick(values, by: str) -> str:
    return f"{_list(values)}[CAST({by} AS BIGINT) % {len(values)} + 1]"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_G = P.DEFAULT
_WORDS = f"words(w, code) AS (VALUES {_values([x for x in _G.words().items() if x[0] not in _G.unsure()])}), codes(w, code) AS (VALUES {_values(_G.codes().items())})"
_PLACE = f"""WITH {_WORDS}, c AS (SELECT c_custkey AS k, c_mktsegment AS seg, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey),
i AS (SELECT *, array_to_string(list_transform(string_split(n, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS nn, upper(seg[1:1]) || lower(seg[2:]) AS ss FROM c),
t AS (SELECT k, CASE WHEN k % 7 < 3 THEN nn WHEN k % 7 < 5 THEN {_pick(STATES, "k // 7")} ELSE {_pick(CODES, "k // 7")} END || {_pick((", ", " / ", " (", " - "), "k // 3")} || CASE k % 4 WHEN 0 THEN {_pick(STATES, "k // 11")} WHEN 1 THEN ss WHEN 2 THEN upper(n) ELSE '' END AS place FROM i),
p AS (SELECT k, trim(unnest(regexp_split_to_array(place, '[,;/|()\\[\\]•·–—]|\\s-\\s'))) AS part FROM t),
f AS (SELECT DISTINCT k, coalesce(words.code, codes.code) AS code FROM p LEFT JOIN words ON words.w = lower(part) LEFT JOIN codes ON codes.w = part AND regexp_matches(part, '^[A-Z][A-Z]$') AND lower(part) NOT IN ({", ".join(map(_q, _G.unsure()))})),
n AS (SELECT k, count(code) AS n, min(code) AS code FROM f GROUP BY 1)
"""
_REGION = f"""WITH {_WORDS}, r(w, cs) AS (VALUES {", ".join("(" + _q(w) + ", " + _list(cs) + ")" for w, cs in P.REGIONS.items())}),
t AS (SELECT c_custkey AS k, unnest(CASE WHEN c_custkey % 3 = 0 THEN [{_pick(REGIONS, "c_custkey")}, {_pick(REGIONS, "c_custkey // 3")}] ELSE [{_pick(REGIONS, "c_custkey")}] END) AS part FROM customer),
f AS (SELECT k, coalesce(cs, CASE WHEN words.code IS NOT NULL THEN [words.code] END) AS cs FROM t LEFT JOIN r ON r.w = lower(part) LEFT JOIN words ON words.w = lower(part)),
g AS (SELECT k, bool_and(cs IS NOT NULL) AS ok, list_sort(list_distinct(flatten(list(cs)))) AS every FROM f GROUP BY 1)
"""
_LEVELS = [(Q._key(x), n, i) for i, (n, ps) in enumerate(Q.LEVELS.items()) for x in ps]
_TEXT = f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderpriority AS p FROM orders),
s AS (SELECT o_orderkey, concat_ws(' ', 'We ask', CASE WHEN k % 3 = 0 THEN {_pick(Q.NUMBERS, "k // 3")} ELSE CAST(k % 23 AS VARCHAR) END || {_pick(SPANS, "k // 7")} || {_pick((" years", " yrs", " year", " Jahre"), "k // 5")}, 'of work, a',
  {_pick(tuple(x for ps in Q.LEVELS.values() for x in ps if x.isascii()) + Q.NOT_ASKED[:4] + ("",) * 6, "k // 2")}, 'in', p, ';', {_pick(PROFICIENT, "k // 11")} || ' ' || {_pick(TONGUES, "k")} || ' and ' || {_pick(TONGUES, "k // 13")}, ',',
  {_pick((*Q.PREFERRED[:14], "a big plus", "5 plus", "ideally first", "regardless of age", "paid time off", "ability to lead") + ("",) * 8, "k // 17")}) AS text FROM o),
x AS (SELECT *, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS key FROM s)
"""
_N = "[0-9][0-9]?|" + "|".join(Q.NUMBERS)
_HAS = "len(list_filter({0}, lambda w: contains(key, ' ' || w || ' '))) > 0"
_PREF = f"({_HAS.format(_list(map(Q._key, Q.PREFERRED)))} OR regexp_matches(text, {_q(Q.PLUS.replace('(?iU)', '(?i)'))}))"
_HEAD = f"""WITH ph(phrase, section, size, ord) AS (VALUES {_values([(Q._key(x), n, len(x), i) for i, (n, ps) in enumerate(Q.SECTIONS.items()) for x in ps])}),
p AS (SELECT p_partkey, p_partkey AS k, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS nn FROM part),
t AS (SELECT p_partkey, CASE WHEN k % 11 = 0 THEN p_name ELSE CASE WHEN k % 5 < 2 THEN nn || ' ' ELSE '' END || {_pick(HEADS, "k")} || CASE WHEN k % 3 = 0 THEN ' & ' || {_pick((*HEADS, "Required"), "k // 3")} ELSE '' END || ':' END AS text FROM p),
x AS (SELECT p_partkey, ' ' || trim(regexp_replace(replace(lower(text), 'ʼ', ' '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS key FROM t),
b AS (SELECT p_partkey, any_value(key) AS key, arg_max(section, (size, -ord)) AS section FROM x LEFT JOIN ph ON contains(key, ' ' || phrase || ' ') GROUP BY 1)
"""
_MODE = f"""WITH o AS (SELECT o_orderkey, o_orderpriority || ' ' || {_pick(HEAD_WORDS, "o_orderkey")} AS head, {_pick(TEXT_WORDS, "o_orderkey // 6")} AS text, o_orderkey % 5 AS flag, o_orderstatus = 'F' AS known FROM orders),
b AS (SELECT *, head || ' ' || text AS ht FROM o), r AS (SELECT *, regexp_matches(ht, '(?i)\\bhybrid\\b') AS hybrid, regexp_matches(head, {_q(Q.REMOTE_WORD)}) OR regexp_matches(ht, {_q(Q.REMOTE_PHRASE)}) AS offered FROM b)
"""
#: masked_contacts, balance_intervals and tracked_alerts cannot be said in SQL; tests hold their operators to results worked out by hand.
ORACLES = {
    "customer_places": _PLACE + "SELECT k AS c_custkey, CASE WHEN n = 1 THEN code END AS code FROM n",
    "remote_limits": _REGION + "SELECT k AS c_custkey, CASE WHEN ok THEN array_to_string(every, ' ') END AS allowed FROM g",
    "sentence_years": _TEXT + f"""SELECT o_orderkey, array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?i)\\b({_N})[ ]*(?:\\+|plus)?[ ]*(?:(?:-|–|to)[ ]*(?:{_N})[ ]*\\+?)?[ ]*\\+?[ ]*(?:years?|yrs?|jahre?n?)', 1), lambda x: coalesce(TRY_CAST(x AS INT), list_position({_list(Q.NUMBERS)}, x))), lambda n: n BETWEEN 1 AND 15), ',') AS years FROM x""",
    "sentence_degrees": _TEXT + f", l(w, level, ord) AS (VALUES {_values(_LEVELS)}) SELECT o_orderkey, CASE WHEN NOT {_HAS.format(_list(map(Q._key, Q.NOT_ASKED)))} THEN (SELECT arg_min(level, ord) FROM l WHERE contains(x.key, ' ' || l.w || ' ')) END AS level FROM x",
    "sentence_languages": _TEXT + f""", c AS (SELECT o_orderkey, trim(unnest(regexp_split_to_array(text, ' *[,;] *| +but +'))) AS text FROM x WHERE regexp_matches(text, '(?i)\\b(fluent|good|spoken|C1|native|language|strong|excellent|advanced|level)\\b') AND NOT regexp_matches(text, {_q(Q.BOILERPLATE)})),
d AS (SELECT *, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS key FROM c),
f AS (SELECT o_orderkey, list_sort(list_distinct(flatten(list(regexp_extract_all(text, '\\b(English|German|Polish|Spanish|French|Turkish|Dutch)\\b'))))) AS l FROM d WHERE NOT {_PREF} GROUP BY 1)
SELECT x.o_orderkey, coalesce(array_to_string(l, ','), '') AS languages FROM x LEFT JOIN f USING (o_orderkey)""",
    "sentence_cues": _TEXT + f""", y AS (SELECT o_orderkey, text, {_PREF} AS preferred, greatest(strpos(text, 'ideally'), strpos(text, 'preferably')) AS pos, regexp_matches(text, {_q(Q.BOILERPLATE)}) AS boilerplate, regexp_matches(text, {_q(Q.ASKS.replace('(?iU)', '(?i)'))}) AS asks, replace(replace(text, 'ideally', ''), 'preferably', '') AS rest FROM x),
z AS (SELECT *, ' ' || trim(regexp_replace(lower(rest), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS key FROM y)
SELECT o_orderkey, preferred, CASE WHEN {_PREF.replace('(text,', '(rest,')} THEN 0 WHEN pos > 0 THEN pos - 1 END AS preferred_from, boilerplate, asks FROM z""",
    "document_sentences": r"""WITH g AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\b(e\.g|i\.e|etc|incl|approx|vs)\.', '\1_', 'gi') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(t, '([.!?;])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS INTEGER) AS n_sentences FROM g""",
    "heading_sections": _HEAD + f"SELECT p_partkey, CASE WHEN section = 'nice_to_have' AND {_HAS.format(_list(map(Q._key, Q.REQUIRED_WORDS)))} THEN 'requirements' ELSE coalesce(section, 'general') END AS section FROM b",
    "posting_modes": _MODE + f"""SELECT o_orderkey, CASE WHEN regexp_matches(ht, {_q(Q.NOT_REMOTE)}) THEN 'on_site' WHEN flag = 0 THEN 'remote' WHEN flag = 1 THEN CASE WHEN hybrid THEN 'hybrid' ELSE 'on_site' END
WHEN hybrid THEN CASE WHEN offered THEN 'remote' ELSE 'hybrid' END WHEN offered OR regexp_matches(text, {_q(Q.REMOTE_WORD)}) THEN 'remote' WHEN regexp_matches(ht, {_q(Q.ON_SITE)}) OR known THEN 'on_site' END AS mode FROM r""",
    "required_wording": """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS have, count(*) AS total FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN have = total AND total = 1 THEN 'You have the one required skill.' WHEN have = total THEN 'You have all ' || total || ' required skills.' WHEN have = 0 AND total = 1 THEN 'You don''t have the one required skill.' WHEN have = 0 THEN 'You have none of the ' || total || ' required skills.' ELSE 'You have ' || have || ' of the ' || total || ' required skills.' END AS sentence, have || ' of ' || total AS short FROM l""",
    "balance_sign_test": """WITH c AS (SELECT c_nationkey, count(*) FILTER (c_acctbal <> 0) AS n, count(*) FILTER (c_acctbal > 0) AS positive FROM customer GROUP BY 1)
SELECT c_nationkey, n, positive, CASE WHEN n > 0 THEN round(least(1.0::DOUBLE, list_sum(list_transform(range(0, least(positive, n - positive) + 1), lambda i: exp(lgamma((n + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma((n - i + 1)::DOUBLE) - (n - 1) * ln(2.0::DOUBLE))))), 6) END AS p FROM c""",
}
