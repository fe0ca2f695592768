"""Ranking of every vacancy for every candidate, and what to read from it.

Input tables: ``vacancies`` (vacancy_id, posted_at, years, mode, country, niches,
required, preferred: arrays of keys, embedding) and ``candidates`` (candidate_id, keys,
months, home, avoid, embedding).

Skills are compared as bits. The candidates' keys are numbered, vacancies' skills are joined
to those numbers once per vacancy (an equi-join, whatever the number of candidates), and a pair
then tests a few bits of the candidate's bitmap. Candidates are broadcast if their rows, bitmaps
included, take ``MOST_BYTES`` at most; a larger set is dealt to blocks of that size, and every part of
the vacancies meets every block by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fitgrid.shared import saved

from . import scoring as S
from .running import numbered

#: Bytes of candidates that are broadcast or meet a part of the vacancies at once, and the parts.
MOST_BYTES, PARTS = 256 << 20, 64
#: Candidates whose products with a vector are kept in one row of it, and the share of the vacancies that bounds a working set.
SLOTS, SHARE = 256, 64
#: Shared skills that a task adds up.
LINKS = 4_000_000
TOP, REACH, LEARN, DEMAND = 50, 3, 4, 5
REASONS = ("on_site_abroad", "remote_outside_region", "experience_short", "risky_niche")
OVERLAP_WARNINGS = ("empty_skill", "duplicate_requirement", "no_vacancy_skills", "no_candidate_skills")


def cleaned(vacancies: DataFrame, empty: str | None = None) -> DataFrame:
    """Skills once per key, one that is both counted as required, empty ones (``empty``, or NULL) left out; with
    what was found in ``skill_warnings``."""
    blank = F.lit(empty) if empty is not None else F.lit(None)

    def real(k: Column) -> Column:
        return k.isNotNull() & ~k.eqNullSafe(blank)

    required, preferred = F.array_distinct(F.filter("required", real)), F.filter("preferred", real)
    left_out = F.exists("required", lambda k: ~real(k)) | F.exists("preferred", lambda k: ~real(k))
    df = vacancies.withColumns({"__r": required, "__p": F.array_except(preferred, required), "__empty": left_out, "__both": F.arrays_overlap(required, preferred)})
    none = (F.size("__r") == 0) & (F.size("__p") == 0)
    found = (F.col("__empty"), F.coalesce(F.col("__both"), F.lit(False)), none)
    codes = F.array_compact(F.array(*(F.when(f, F.lit(w)) for f, w in zip(found, OVERLAP_WARNINGS, strict=False))))
    return df.withColumns({"required": F.col("__r"), "preferred": F.col("__p"), "skill_warnings": codes}).drop("__r", "__p", "__empty", "__both")


def _numbered(candidates: DataFrame) -> DataFrame:
    """The candidates' distinct keys (key, bit), bit from 0 without gaps."""
    every = candidates.select(F.explode("keys").alias("key")).distinct()
    return numbered(every, [], ["key"], "bit").select("key", (F.col("bit") - 1).cast("int").alias("bit"))


def _with_bits(candidates: DataFrame, numbers: DataFrame, words: int) -> DataFrame:
    """``bits``: 64 keys of a candidate to a number, ``words`` numbers in all."""
    own = candidates.select("candidate_id", F.explode(F.array_distinct("keys")).alias("key")).join(numbers, "key")
    own = own.groupBy("candidate_id", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("b"))
    own = own.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "b"))).alias("__of"))
    at = F.sequence(F.lit(0), F.lit(words - 1)) if words else F.array().cast("array<int>")
    bits = F.transform(at, lambda w: F.coalesce(F.try_element_at("__of", w), F.lit(0).cast("long")))
    return candidates.join(own, "candidate_id", "left").withColumn("bits", bits).drop("__of")


def _with_numbers(vacancies: DataFrame, numbers: DataFrame) -> DataFrame:
    """``required_bits`` and ``preferred_bits``: the numbers of those skills that any candidate has."""
    skills = vacancies.select("vacancy_id", F.explode(F.concat(F.transform("required", lambda k: F.struct(k.alias("key"), F.lit(True).alias("must"))), F.transform("preferred", lambda k: F.struct(k.alias("key"), F.lit(False).alias("must"))))).alias("s")).select("vacancy_id", "s.*")
    found = skills.join(numbers, "key").groupBy("vacancy_id").agg(F.collect_list(F.when(F.col("must"), F.col("bit"))).alias("required_bits"), F.collect_list(F.when(~F.col("must"), F.col("bit"))).alias("preferred_bits"))
    none = F.array().cast("array<int>")
    return vacancies.join(found, "vacancy_id", "left").withColumns({c: F.coalesce(c, none) for c in ("required_bits", "preferred_bits")})


def bytes_of(candidates: DataFrame) -> tuple[int, int]:
    """What the candidates' rows take with their bitmaps, and the bitmaps' words. The distinct keys are the words' number,
    so they are counted; a broadcast of the keys themselves is less than one of the candidates."""
    vectors = F.coalesce(F.max(F.size("c_embedding")), F.lit(0)) if "c_embedding" in candidates.columns else F.lit(0)
    n, keys, dims = candidates.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0)), vectors).collect()[0]
    words = -(-candidates.select(F.explode("keys").alias("key")).distinct().count() // 64)
    return n * (200 + 8 * max(dims, 0) + 8 * words) + 24 * keys, words


def _with_products(vacancies: DataFrame, candidates: DataFrame, vectors: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Vacancies that name a vector (``vector_id``), ready to be paired: with the products of that vector and each candidate's, by
    the candidates' ``__slot``, or with the vector itself where the candidates are many. A product is worked out once a
    vector, not once a vacancy."""
    if not few or candidates.count() > SLOTS:
        return vacancies.join(vectors, "vector_id", "left").drop("vector_id"), candidates
    candidates = numbered(candidates, [], ["candidate_id"], "__slot")
    each = vectors.withColumn("__row", F.monotonically_increasing_id()).crossJoin(F.broadcast(candidates.select("__slot", "c_embedding")))
    each = each.groupBy("vector_id", "__row").agg(F.collect_list(F.struct("__slot", S.dot(F.col("embedding"), F.col("c_embedding")).alias("p"))).alias("__p"))
    products = each.select("vector_id", F.transform(F.array_sort("__p"), lambda x: x["p"]).alias("__products"))
    return vacancies.join(saved(products, "products"), "vector_id", "left").drop("vector_id"), candidates


def pairs(vacancies: DataFrame, candidates: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Every candidate with every vacancy: that is the operator, so no key can narrow it. The candidates are broadcast
    only after the bytes of their rows are checked; beyond that they are dealt to blocks of MOST_BYTES, and each part of
    the vacancies (PARTS of them) meets each block by an equi-join, so that a task holds one block at a time. With ``vectors``
    (vector_id, embedding) vacancies have a ``vector_id`` and no embedding."""
    size, words = bytes_of(candidates)
    few = size <= MOST_BYTES
    if vectors is not None:
        vacancies, candidates = _with_products(vacancies, candidates, vectors, few)
    numbers = _numbered(candidates)
    numbers = F.broadcast(numbers) if few else numbers
    vacancies, candidates = _with_numbers(cleaned(vacancies), numbers), _with_bits(candidates, numbers, words)
    if few:
        return vacancies.crossJoin(F.broadcast(candidates))
    blocks = 1 + size // MOST_BYTES
    vacancies = vacancies.withColumns({"__part": F.pmod(F.xxhash64("vacancy_id"), F.lit(PARTS)), "__block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))})
    candidates = candidates.withColumns({"__block": F.pmod(F.xxhash64("candidate_id"), F.lit(blocks)), "__part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>"))})
    return vacancies.join(candidates, ["__block", "__part"]).drop("__block", "__part")


def _matched(bits: str) -> Column:
    """How many of a vacancy's numbered skills the candidate has."""
    return F.aggregate(bits, F.lit(0), lambda acc, i: acc + F.getbit(F.get("bits", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))).cast("int"))


def scored(paired: DataFrame, weights: S.Weights = S.Weights(), floor: float | None = None, ceil: float | None = None) -> DataFrame:
    """Counts, parts, fit and band of each pair, with the rules of eligibility as columns."""
    known = "__products" in paired.columns
    raw = F.get("__products", F.col("__slot").cast("int") - 1) if known else S.dot(F.col("embedding"), F.col("c_embedding"))
    df = paired.withColumns({"n_required": F.size("required"), "n_preferred": F.size("preferred"), "required_matched": _matched("required_bits"), "preferred_matched": _matched("preferred_bits"), "semantic_raw": raw})
    df = df.drop("__products", "__slot")
    df = df.withColumns({
        "skill": S.overlap_score(F.col("required_matched"), F.col("n_required"), F.col("preferred_matched"), F.col("n_preferred")),
        "required_coverage": S.coverage(F.col("required_matched"), F.col("n_required")),
        "semantic": S.calibrated(F.col("semantic_raw"), floor, ceil),
        "experience": S.experience_fit(F.col("years"), F.col("months")),
    })
    df = df.withColumn("fit", S.linear_fit(F.col("skill"), F.col("semantic"), F.col("experience"), weights))
    df = df.withColumn("before_cap", S.band_rank(F.col("fit"), F.coalesce("required_coverage", "skill")))
    short = F.coalesce(F.col("experience") == 0, F.lit(False))
    abroad = F.coalesce(F.col("mode").isin("on_site", "hybrid") & (F.col("country") != F.col("home")), F.lit(False))
    outside = F.coalesce((F.col("mode") == "remote") & ~F.array_contains("allowed", F.col("home")), F.lit(False)) if "allowed" in paired.columns else F.lit(False)
    niche = F.coalesce(F.arrays_overlap("niches", "avoid"), F.lit(False))
    flags = (abroad, outside, short, niche)
    df = df.withColumn("reasons", F.array_compact(F.array(*(F.when(f, F.lit(r)) for f, r in zip(flags, REASONS, strict=True)))))
    df = df.withColumn("hidden", abroad | outside | niche)
    return df.withColumn("band_rank", S.capped(F.col("before_cap"), F.when(short, 1)))


def _order() -> list[Column]:
    return [F.col("band_rank"), F.desc_nulls_last("fit"), F.desc_nulls_last("posted_at"), F.col("vacancy_id")]


def ranked(df: DataFrame) -> DataFrame:
    """``rank`` among the visible pairs of a candidate: band, fit, newest, id; unknown last. The pairs are kept once scored,
    without skills and vectors; the visible ones are numbered by ranges of the order, as a candidate has as many pairs as
    there are vacancies, and hidden ones have no rank and are not sorted. Select what is wanted before: all columns are kept."""
    plain = [f.name for f in df.schema if f.name == "reasons" or not isinstance(f.dataType, ArrayType)]
    kept = saved(df.select(*plain), "scored")
    place = numbered(kept.filter(~F.col("hidden")), ["candidate_id"], _order(), "rank")
    return place.unionByName(kept.filter("hidden").withColumn("rank", F.lit(None).cast(place.schema["rank"].dataType)))


def band_counts(df: DataFrame) -> DataFrame:
    """Visible pairs by band; every band has a column, empty or not."""
    visible = ~F.col("hidden")
    return df.groupBy("candidate_id").agg(*(F.count_if(visible & (F.col("band_rank") == i)).alias(b) for i, b in enumerate(S.BANDS)), F.count_if(F.col("hidden")).alias("hidden_count"))


def _no_worse(df: DataFrame, most: int) -> DataFrame:
    """The scored pairs that may be among the first ``most`` visible ones of their candidate. The ``most``-th of one in SHARE of the
    vacancies comes no earlier in the order than that of all of them, so whatever comes after it goes before any
    row is sorted. A candidate with fewer pairs there keeps them all."""
    order = Window.partitionBy("candidate_id").orderBy(*_order())
    some = df.filter((F.pmod(F.xxhash64("vacancy_id"), F.lit(SHARE)) == 0) & ~F.col("hidden")).select("candidate_id", "vacancy_id", "posted_at", "band_rank", "fit")
    last = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).filter(F.col("n") == most)
    bound = saved(last.select(F.col("candidate_id").alias("__of"), F.col("band_rank").alias("__band"), F.col("fit").alias("__fit")), "bounds")
    met = df.filter(~F.col("hidden")).join(bound, F.col("candidate_id") == F.col("__of"), "left")
    before = (F.col("band_rank") < F.col("__band")) | ((F.col("band_rank") == F.col("__band")) & (F.col("__fit").isNull() | (F.col("fit") >= F.col("__fit"))))
    return met.filter(F.when(F.col("__of").isNull(), True).otherwise(F.coalesce(before, F.lit(False)))).drop("__of", "__band", "__fit")


def first_ranked(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` visible pairs of each candidate with their ``rank``, from scored pairs."""
    order = Window.partitionBy("candidate_id").orderBy(*_order())
    return _no_worse(df, most).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def working_set(df: DataFrame, top: int = TOP) -> DataFrame:
    """The first visible pairs that have a fit, in ranking order, from scored pairs. Pairs without a fit come last in
    that order, so they may go once the first are found."""
    return first_ranked(df, top).filter(F.col("fit").isNotNull())


def page(df: DataFrame, number: int, size: int | None = None) -> DataFrame:
    """A page of the ranking, from 1; all of it without a size, nothing past its end."""
    if number < 1 or (size is not None and size < 1):
        raise ValueError("pages and their sizes start at 1")
    first = (number - 1) * (size or 0)
    found = df.filter(F.col("rank").isNotNull())
    return found.filter(F.col("rank").between(first + 1, first + size)) if size else found.filter(F.lit(number == 1))


def hidden_unexplained(df: DataFrame, explained: tuple[str, ...]) -> DataFrame:
    """Hidden pairs of a candidate none of whose reasons is one that can be explained."""
    unsaid = F.col("hidden") & ~F.arrays_overlap("reasons", F.array(*map(F.lit, explained)))
    return df.groupBy("candidate_id").agg(F.count_if(unsaid).alias("hidden_unexplained"))


def _band_with(df: DataFrame, more: Column, weights: S.Weights = S.Weights()) -> tuple[Column, Column]:
    """Fit and band of a pair whose candidate had ``more`` of the missing required skills."""
    matched = F.col("required_matched") + more
    skill = S.overlap_score(matched, F.col("n_required"), F.col("preferred_matched"), F.col("n_preferred"))
    fit = S.linear_fit(skill, F.col("semantic"), F.col("experience"), weights)
    cap = F.when(F.array_contains("reasons", "experience_short"), 1)
    return fit, S.capped(S.band_rank(fit, F.coalesce(S.coverage(matched, F.col("n_required")), skill)), cap)


def within_reach(work: DataFrame, most: int = REACH, weights: S.Weights = S.Weights()) -> DataFrame:
    """Partial matches that one or two more required skills make strong; with unit weights any missing skill
    gives the same fit, so the first of the vacancy's order are named."""
    missing = F.array_except("required", "keys")
    df = work.filter("band_rank = 1").withColumn("missing", missing)
    (f1, b1), (f2, b2) = _band_with(df, F.lit(1), weights), _band_with(df, F.lit(2), weights)
    n = F.size("missing")
    df = df.withColumn("n_added", F.when((n >= 1) & (b1 == 0), 1).when((n >= 2) & (b2 == 0), 2)).filter("n_added IS NOT NULL")
    df = df.withColumns({"fit_after": F.when(F.col("n_added") == 1, f1).otherwise(f2), "added": F.slice("missing", 1, F.col("n_added"))})
    order = Window.partitionBy("candidate_id").orderBy("n_added", F.desc_nulls_last("fit"), "vacancy_id")
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def worth_learning(work: DataFrame, most: int = LEARN, weights: S.Weights = S.Weights()) -> DataFrame:
    """Missing required skills that make vacancies strong: gain, then frequency, then key."""
    _, band = _band_with(work, F.lit(1), weights)
    df = work.withColumns({"unlocks": (F.col("band_rank") != 0) & (band == 0), "key": F.explode(F.array_except("required", "keys"))})
    df = df.groupBy("candidate_id", "key").agg(F.count_if("unlocks").alias("gain"), F.count("*").alias("frequency")).filter("gain > 0")
    order = Window.partitionBy("candidate_id").orderBy(F.desc("gain"), F.desc("frequency"), "key")
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def in_demand(work: DataFrame, most: int = DEMAND) -> DataFrame:
    """The candidate's skills by how many vacancies require them."""
    df = work.select("candidate_id", F.explode(F.array_intersect("required", "keys")).alias("key")).groupBy("candidate_id", "key").agg(F.count("*").alias("n"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("n"), "key"))).filter(F.col("place") <= most)


def _with_key_weights(work: DataFrame, key_weights: DataFrame) -> DataFrame:
    """The working set with ``all_w`` and ``hit_w`` (weights of all skills of a pair, and of those the candidate has) and ``missing``:
    required skills the candidate lacks, in the vacancy's order, with their weights. ``key_weights`` are (key, w), 1 where a key has none."""
    w = F.coalesce("w", F.lit(1.0))
    checked = F.when((w > 0) & (w < float("inf")), w).otherwise(F.raise_error(F.lit("weights must be positive and finite")).cast("double"))

    def each(skills: str, must: bool) -> DataFrame:
        return work.select("candidate_id", "vacancy_id", "keys", F.posexplode(skills).alias("pos", "key"), F.lit(must).alias("must"))

    df = each("required", True).unionByName(each("preferred", False)).join(key_weights.select("key", "w"), "key", "left")
    df = df.withColumns({"own": checked * F.when(F.col("must"), S.REQUIRED).otherwise(S.PREFERRED), "has": F.array_contains("keys", F.col("key"))})
    lacks = F.when(F.col("must") & ~F.col("has"), F.struct("pos", "key", "own"))
    sums = df.groupBy("candidate_id", "vacancy_id").agg(F.sum("own").alias("all_w"), F.sum(F.when(F.col("has"), F.col("own")).otherwise(0.0)).alias("hit_w"), F.array_sort(F.collect_list(lacks)).alias("missing"))
    return work.join(sums, ["candidate_id", "vacancy_id"])


def _after(more: Column, count: Column, weights: S.Weights) -> tuple[Column, Column]:
    """Fit and band of a pair whose candidate had ``count`` more of the required skills, ``more`` by weight."""
    skill = F.least(F.lit(1.0), (F.col("hit_w") + more) / F.col("all_w"))
    fit = S.linear_fit(skill, F.col("semantic"), F.col("experience"), weights)
    cap = F.when(F.array_contains("reasons", "experience_short"), 1)
    return fit, S.capped(S.band_rank(fit, F.coalesce(S.coverage(F.col("required_matched") + count, F.col("n_required")), skill)), cap)


def weighted_reach(work: DataFrame, key_weights: DataFrame, most: int = REACH, weights: S.Weights = S.Weights()) -> DataFrame:
    """``within_reach`` where skills have weights: the one missing skill, or else the two, that make a partial match strong with the
    greatest fit, the first in the vacancy's order of equals. Fit grows with the weight that is added and nothing else, so
    the heaviest skills are the best subset of their size and no other has to be tried."""
    df = _with_key_weights(work.filter("band_rank = 1"), key_weights)
    heavy = F.transform("missing", lambda x: F.struct((-x["own"] if weights.skill else F.lit(0.0)).alias("less"), x["pos"].alias("pos"), x["key"].alias("key"), x["own"].alias("own")))
    df = df.withColumn("heavy", F.array_sort(heavy))
    one, two = F.get("heavy", 0), F.get("heavy", 1)
    (f1, b1), (f2, b2) = _after(one["own"], F.lit(1), weights), _after(one["own"] + two["own"], F.lit(2), weights)
    df = df.withColumn("n_added", F.when(one.isNotNull() & (b1 == 0), 1).when(two.isNotNull() & (b2 == 0), 2)).filter("n_added IS NOT NULL")
    added = F.transform(F.array_sort(F.transform(F.slice("heavy", 1, F.col("n_added")), lambda x: F.struct(x["pos"], x["key"]))), lambda x: x["key"])
    df = df.withColumns({"fit_after": F.when(F.col("n_added") == 1, f1).otherwise(f2), "added": added})
    order = Window.partitionBy("candidate_id").orderBy("n_added", F.desc_nulls_last("fit"), "vacancy_id")
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _by_label(df: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """``df`` with the keys' labels (key, label), and an order by label without case, then key."""
    if labels is None:
        return df.withColumn("label", F.col("key").cast("string")), [F.col("key")]
    df = df.join(labels.select("key", "label"), "key", "left").withColumn("label", F.coalesce("label", F.col("key").cast("string")))
    return df, [F.lower("label"), F.col("label"), F.col("key")]


def weighted_learning(work: DataFrame, key_weights: DataFrame, labels: DataFrame | None = None, most: int = LEARN, weights: S.Weights = S.Weights()) -> DataFrame:
    """``worth_learning`` where skills have weights, with the vacancies (in their ranking's order) that each skill makes strong;
    gain, then frequency, then label."""
    df = _with_key_weights(work, key_weights).select("*", F.explode("missing").alias("x"))
    _, band = _after(F.col("x.own"), F.lit(1), weights)
    unlocked = F.when((F.col("band_rank") != 0) & (band == 0), F.struct("rank", "vacancy_id"))
    df = df.withColumns({"key": F.col("x.key"), "u": unlocked}).groupBy("candidate_id", "key").agg(F.count("u").alias("gain"), F.count("*").alias("frequency"), F.transform(F.array_sort(F.collect_list("u")), lambda x: x["vacancy_id"]).alias("vacancies"))
    df, order = _by_label(df.filter("gain > 0"), labels)
    w = Window.partitionBy("candidate_id").orderBy(F.desc("gain"), F.desc("frequency"), *order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def weighted_overlap(skills: DataFrame, keys: DataFrame, weights: DataFrame) -> DataFrame:
    """Overlap of the pairs that share a skill, with a weight a key: skills (vacancy_id, key, must), keys (candidate_id,
    key), weights (key, w; 1 where a key has none). All other pairs overlap by nothing. A weight that is no positive
    finite number is an error of whoever gave it. Vacancies are dealt to as many tasks as keep LINKS shared skills each, which
    are counted by key first, and stay there until their pairs are added up."""
    w = F.coalesce("w", F.lit(1.0))
    checked = F.when((w > 0) & (w < float("inf")), w).otherwise(F.raise_error(F.lit("weights must be positive and finite")).cast("double"))
    wanted, held = (df.groupBy("key").agg(F.count("*").alias(n)) for df, n in ((skills, "__v"), (keys, "__c")))
    links = wanted.join(held, "key").agg(F.coalesce(F.sum(F.col("__v") * F.col("__c")), F.lit(0))).collect()[0][0]
    df = skills.join(weights.select("key", "w"), "key", "left").withColumn("__w", checked * F.when(F.col("must"), S.REQUIRED).otherwise(S.PREFERRED))
    df = df.repartition(1 + links // LINKS, "vacancy_id").withColumn("__all", F.sum("__w").over(Window.partitionBy("vacancy_id")))
    hit = df.join(keys.select("candidate_id", "key"), "key").groupBy("vacancy_id", "candidate_id", "__all").agg(F.sum("__w").alias("__hit"))
    return hit.select("candidate_id", "vacancy_id", F.least(F.lit(1.0), F.col("__hit") / F.col("__all")).alias("score"))


def adjusted(df: DataFrame, given: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with a caller's own adjustments (by, hidden, cap, reason), to be merged once it is scored. Those of a vacancy are
    joined to the vacancies, not to their pairs."""
    more = given.groupBy(*by).agg(F.bool_or("hidden").alias("__hidden"), F.max("cap").alias("__cap"), F.array_sort(F.collect_set("reason")).alias("__reasons"))
    return df.join(more, by, "left")


def merged_adjustments(df: DataFrame, given: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Pairs (hidden, band_rank, reasons) with a caller's own adjustments (by, hidden, cap, reason), or those that they have
    from ``adjusted``: hidden by any, the worst cap, reasons in the order of the rules and then of the caller's, each once."""
    if given is not None:
        df = adjusted(df, given, by)
    reasons = F.array_distinct(F.concat("reasons", F.coalesce("__reasons", F.array().cast("array<string>"))))
    return df.withColumns({"hidden": F.col("hidden") | F.coalesce("__hidden", F.lit(False)), "band_rank": S.capped(F.col("band_rank"), F.col("__cap")), "reasons": reasons}).drop("__hidden", "__cap", "__reasons")
