"""What postings ask for, from their descriptions, as one plan over lines and sentences; from tags where there is no text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.shared import saved

from ..functions import lines as L
from ..functions import requirements as Q
from ..functions.options import option_lists
from ..functions.text import normalize

# Skills that are everyday words too, words that are no skills, tags that are no skills, and limits.
AMBIGUOUS = ("go", "r", "c", "d", "spring", "rest", "swift", "express", "less", "make", "chef", "puppet", "ant", "dart", "rust", "ember", "flask", "sass", "elm", "julia", "crystal", "salt", "maven", "gradle", "jest", "mocha", "vue", "meteor", "backbone", "nest")
TAG_STOP = ("remote", "hybrid", "onsite", "on site", "full time", "part time", "contract", "freelance", "internship", "worldwide", "anywhere")
MAX_SKILLS, FEW_SKILLS, SHORT = 25, 3, 2
ASKING, SECTIONED = ("requirements", "nice_to_have"), ("requirements", "nice_to_have", "responsibilities")


def section_lines(postings: DataFrame) -> DataFrame:
    """Lines (id, at, text, bullet, section) of postings (id, description) with text enough to read, other sections left out.

    Postings are dealt by id before they are parsed, as a file of few row groups would be parsed by few tasks. A filter on what the
    parser returns, also the one that the planner infers from an inner posexplode, would be pushed below it and parse every text
    again."""
    lines = postings.select("id", "description").repartition("id").select("id", L.usable_lines_of(F.col("description")).alias("l"))
    rows = lines.select("id", F.posexplode_outer("l").alias("at", "x")).filter("x IS NOT NULL").select("id", "at", "x.*")
    return Q.sectioned(rows, "id", "at").filter("section <> 'other'")


def sentence_rows(lines: DataFrame) -> DataFrame:
    """Sentences (id, at, s, text, section) that are no boilerplate."""
    rows = lines.select("id", "at", "section", F.posexplode_outer(Q.sentences(F.col("text"))).alias("s", "text"))
    return rows.filter(F.col("text").isNotNull() & ~Q.is_boilerplate(F.col("text")))


def _languages() -> list[str]:
    return [n.lower() for n in Q.LANGUAGES]


def skills(sentences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Skills (id, norm, skill, preferred) that sentences name, each once: required if it is so anywhere.

    A skill is preferred in a section of such, in a sentence that states a preference, behind a cue that counts for what follows,
    and as one of several examples or alternatives (see ``option_lists``). ``quote`` is the sentence it is taken from. An everyday word needs a capital and another skill in its line; a weak alias needs a section that asks, a
    posting without sections, or a sentence that asks. Names of languages are no skills.
    """
    keys = ["id", "at", "s"]
    hits = L.skill_hits(sentences.select(*keys, "text"), keys, L.telling(vocabulary)).join(sentences, keys)
    # where a preference starts, and lists, only of sentences that name a skill
    hits = hits.withColumns({"from": Q.preferred_from(F.col("text")), "lists": option_lists(F.col("text"))})
    # lists by words: those that begin before a place in the text
    upto = lambda at: F.size(L.tokens(F.substring(F.col("text"), F.lit(1), at)))
    hits = hits.withColumn("lists", F.transform("lists", lambda x: F.struct(upto(x["start"]).alias("lo"), upto(x["end"]).alias("hi"), x["sure"].alias("sure"))))
    places = F.collect_list("place").over(Window.partitionBy(*keys))
    hits = hits.withColumn("places", places).withColumn("option", F.exists("lists", lambda x: (F.col("place") > x["lo"]) & (F.col("place") <= x["hi"]) & (x["sure"] | (F.size(F.filter("places", lambda p: (p > x["lo"]) & (p <= x["hi"]))) >= 2))))
    unsure = (F.length("norm") <= SHORT) | F.col("norm").isin(*AMBIGUOUS)
    line = Window.partitionBy("id", "at")
    known = sentences.groupBy("id").agg(F.bool_or(F.col("section").isin(*SECTIONED)).alias("structured"))
    hits = hits.join(known, "id").withColumns({"unsure": unsure, "others": F.count_if(~unsure).over(line)})
    capital = F.substring("skill", 1, 1).rlike(r"\p{Lu}")
    hits = hits.filter((~F.col("unsure") | (capital & (F.col("others") > 0))) & ~F.col("norm").isin(*_languages()))
    hits = hits.filter(~F.col("weak") | F.col("section").isin(*ASKING) | ~F.col("structured") | Q.asks(F.col("text")))
    before = F.size(L.tokens(F.substring(F.col("text"), F.lit(1), F.col("from"))))
    behind = F.when(F.col("from") == 0, True).otherwise(F.col("place") > before)
    hits = hits.withColumn("preferred", (F.col("section") == "nice_to_have") | F.coalesce(F.col("from").isNotNull() & behind, F.lit(False)) | F.col("option"))
    place = F.struct("at", "s", "place")
    found = hits.groupBy("id", "norm").agg(F.bool_and("preferred").alias("preferred"), F.min_by("skill", F.struct("preferred", place)).alias("skill"), F.min(F.struct("preferred", place)).alias("__at"), F.min_by("text", F.struct("preferred", place)).alias("quote"))
    return found.select("id", "norm", "skill", "preferred", F.col("__at").alias("order"), "quote")


def _in_order(when: Column, what: str = "skill") -> Column:
    return F.slice(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("order", what)))), lambda x: x[what]), 1, MAX_SKILLS)


def extracted(postings: DataFrame, vocabulary: DataFrame, complete: bool = True) -> DataFrame:
    """One row a posting (id, description, tags): required, preferred, the quotes of both, responsibilities, min_years, education,
    languages (NULL where there is no text), warnings. Where the text names few skills, tags that the vocabulary knows are added.
    ``complete`` says that the vocabulary is the whole taxonomy. Texts are parsed once and kept, as five branches read them."""
    none = F.array().cast("array<string>")
    vocabulary = L.telling(vocabulary)
    lines = saved(section_lines(postings), "lines")
    sentences = saved(sentence_rows(lines), "sentences")
    found = saved(skills(sentences, vocabulary), "skills")
    wanted, wished = ~F.col("preferred"), F.col("preferred")
    named = found.groupBy("id").agg(_in_order(wanted).alias("required"), _in_order(wished).alias("preferred"), _in_order(wanted, "quote").alias("required_quotes"), _in_order(wished, "quote").alias("preferred_quotes"))
    asked = sentences.filter("section IN ('requirements', 'general')").withColumn("from", F.when(Q.may_state(F.col("text")), Q.preferred_from(F.col("text")))).withColumn("part", F.when(F.col("from").isNull(), F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), F.col("from"))))
    at = F.struct("at", "s")
    facts = asked.withColumns({"years": F.array_max(Q.years_in(F.col("part"))), "level": Q.education_in(F.col("part")), "spoken": Q.languages_in(F.col("text"))})
    facts = facts.groupBy("id").agg(F.max("years").alias("min_years"), F.min_by(F.col("level"), F.when(F.col("level").isNotNull(), at)).alias("education"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), "spoken"))), lambda x: x["spoken"]))).alias("languages"))
    duties = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text", "bullet", "section"))), lambda x: F.struct(x["text"].alias("text"), x["bullet"].alias("bullet"), x["section"].alias("section"))).alias("l")).select("id", Q.responsibilities(F.col("l")).alias("responsibilities"), F.lit(True).alias("read"))
    tags = postings.select("id", Q.tags_kept(F.coalesce("tags", none)).alias("tags"))
    each = tags.select("id", F.posexplode("tags").alias("pos", "tag")).withColumn("norm", normalize(F.col("tag"))).filter(~F.col("norm").isin(*TAG_STOP))
    each = each.withColumn("low", F.lower("tag")).join(found.select("id", F.lower("skill").alias("low")).distinct(), ["id", "low"], "left_anti")
    known = each.join(vocabulary.select(F.col("alias_norm").alias("norm")).distinct(), "norm", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("known"))
    df = tags
    for other in (duties, named, facts, known):
        df = df.join(other, "id", "left")
    read = F.coalesce("read", F.lit(False))
    required, preferred = F.coalesce("required", none), F.coalesce("preferred", none)
    few = F.size(required) + F.size(preferred) < FEW_SKILLS
    added = F.when(few, F.coalesce("known", none)).otherwise(none)
    whole = F.when(read, F.slice(F.concat(required, added), 1, MAX_SKILLS)).otherwise(F.col("tags"))
    empty = (F.size(whole) == 0) & (F.size(preferred) == 0)
    codes = F.array_compact(F.array(F.when(~read, "tags_fallback"), F.when(read & (F.size(added) > 0), "tags_added"), F.when(read & F.lit(not complete), "partial_vocabulary"), F.when(empty, "no_requirements")))
    return df.select("id", whole.alias("required"), F.when(read, preferred).otherwise(none).alias("preferred"), *(F.when(read, F.coalesce(q, none)).otherwise(none).alias(q) for q in ("required_quotes", "preferred_quotes")), F.coalesce("responsibilities", none).alias("responsibilities"), "min_years", "education", F.when(read, F.coalesce("languages", none)).alias("languages"), codes.alias("warnings"))
