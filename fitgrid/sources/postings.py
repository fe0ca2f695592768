"""Feeds of postings, read as text with one JSON page per row, brought to one shape.

Each adapter takes pages (page int, body string) and gives rows with a status:
``kept``, ``filtered`` (not wanted) or ``skipped`` (no id, link or title).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id, text_or_none

COLUMNS = ("source", "source_id", "url", "title", "company", "location_raw", "remote", "country", "posted_at", "description", "description_is_excerpt", "tags", "category", "employment_type", "salary_raw")


def parse_time(col: Column) -> Column:
    """ISO text (a date without a zone is UTC) or seconds since 1970; NULL if unreadable."""
    number = F.try_to_number(col, F.lit("9999999999")).cast("long")
    iso = F.regexp_replace(F.regexp_replace(F.trim(col), r"(\.\d{6})\d+", "$1"), r"(?<=:\d\d)(\.\d+)?([+-]\d\d)(\d\d)$", "$1$2:$3")
    day, clock = iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso.rlike(r"(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    zoned = F.when(day, F.concat(iso, F.lit("T00:00:00Z"))).when(clock, iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.coalesce(F.when(col.rlike(r"^\d{1,10}$"), F.timestamp_seconds(number)), F.try_to_timestamp(zoned))


def _items(pages: DataFrame, path: str, item: str) -> DataFrame:
    body = F.from_json("body", f"STRUCT<{path}: ARRAY<STRUCT<{item}>>>")
    return pages.select("page", F.posexplode(body[path]).alias("at", "i"))


def _shaped(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    kinds = {"remote": "boolean", "posted_at": "timestamp", "description_is_excerpt": "boolean", "tags": "array<string>"}
    out = {c: cols.get(c, F.lit(False) if c == "description_is_excerpt" else F.lit(None)).cast(kinds.get(c, "string")) for c in COLUMNS if c != "source"}
    wanted = cols.get("wanted", F.lit(True))
    whole = out["source_id"].isNotNull() & text_or_none(out["url"]).isNotNull() & text_or_none(out["title"]).isNotNull()
    status = F.when(~F.coalesce(wanted, F.lit(False)), "filtered").when(whole, "kept").otherwise("skipped")
    return df.select("page", "at", F.lit(source).alias("source"), *(v.alias(k) for k, v in out.items()), status.alias("status"))


def arbeitnow(pages: DataFrame, remote_only: bool = True) -> DataFrame:
    i = F.col("i")
    df = _items(pages, "data", "slug STRING, url STRING, title STRING, company_name STRING, location STRING, remote BOOLEAN, created_at STRING, description STRING, tags ARRAY<STRING>, job_types ARRAY<STRING>")
    return _shaped(df, "arbeitnow", wanted=i["remote"] if remote_only else F.lit(True), source_id=i["slug"], url=i["url"], title=i["title"], company=text_or_none(i["company_name"]), location_raw=text_or_none(i["location"]), remote=i["remote"], posted_at=parse_time(i["created_at"]), description=text_or_none(i["description"]), tags=i["tags"], employment_type=text_or_none(F.array_join(i["job_types"], ", ")))


def themuse(pages: DataFrame, remote_only: bool = True) -> DataFrame:
    i = F.col("i")
    df = _items(pages, "results", "id STRING, name STRING, refs STRUCT<landing_page: STRING>, company STRUCT<name: STRING>, locations ARRAY<STRUCT<name: STRING>>, publication_date STRING, contents STRING, tags ARRAY<STRUCT<name: STRING>>, categories ARRAY<STRUCT<name: STRING>>, type STRING")
    places = i["locations"]["name"]
    remote = F.coalesce(F.exists(places, lambda p: F.lower(p).contains("remote") | F.lower(p).contains("flexible")), F.lit(False))
    return _shaped(df, "themuse", wanted=remote if remote_only else F.lit(True), source_id=i["id"], url=i["refs"]["landing_page"], title=i["name"], company=text_or_none(i["company"]["name"]), location_raw=text_or_none(F.array_join(places, ", ")), remote=remote, posted_at=parse_time(i["publication_date"]), description=text_or_none(i["contents"]), tags=i["tags"]["name"], category=F.get(i["categories"]["name"], 0), employment_type=text_or_none(i["type"]))


def jooble(pages: DataFrame) -> DataFrame:
    i = F.col("i")
    df = _items(pages, "jobs", "id STRING, link STRING, title STRING, company STRING, location STRING, updated STRING, snippet STRING, type STRING, salary STRING")
    return _shaped(df, "jooble", source_id=F.coalesce(text_or_none(i["id"]), stable_id(i["link"])), url=i["link"], title=i["title"], company=text_or_none(i["company"]), location_raw=text_or_none(i["location"]), posted_at=parse_time(i["updated"]), description=text_or_none(i["snippet"]), description_is_excerpt=F.lit(True), employment_type=text_or_none(i["type"]), salary_raw=text_or_none(i["salary"]))


def salary_range(low: Column, high: Column, estimated: Column) -> Column:
    """The known ends in whole numbers with thousands, once where they are equal, and whether they are an estimate."""
    ends = F.array_distinct(F.array_compact(F.array(low, high)))
    text = F.array_join(F.transform(ends, lambda x: F.format_number(x, 0)), " - ")
    return F.when(F.size(ends) > 0, F.concat(text, F.when(estimated == "1", " (estimated)").otherwise("")))


def adzuna(pages: DataFrame, country: str = "gb") -> DataFrame:
    """Every result of a search is a posting of the searched country."""
    i = F.col("i")
    df = _items(pages, "results", "id STRING, redirect_url STRING, title STRING, company STRUCT<display_name: STRING>, location STRUCT<display_name: STRING>, created STRING, description STRING, category STRUCT<label: STRING>, contract_time STRING, salary_min DOUBLE, salary_max DOUBLE, salary_is_predicted STRING")
    return _shaped(df, "adzuna", source_id=i["id"], url=i["redirect_url"], title=i["title"], company=text_or_none(i["company"]["display_name"]), location_raw=text_or_none(i["location"]["display_name"]), country=F.lit(country.upper()), posted_at=parse_time(i["created"]), description=text_or_none(i["description"]), description_is_excerpt=F.lit(True), category=text_or_none(i["category"]["label"]), employment_type=text_or_none(i["contract_time"]), salary_raw=salary_range(i["salary_min"], i["salary_max"], i["salary_is_predicted"]))


def remotive(pages: DataFrame) -> DataFrame:
    """A feed of remote jobs only; the id is a number, the address http(s)."""
    i = F.col("i")
    df = _items(pages, "jobs", "id STRING, url STRING, title STRING, company_name STRING, category STRING, tags ARRAY<STRING>, job_type STRING, publication_date STRING, candidate_required_location STRING, salary STRING, description STRING")
    number = F.when(F.trim(i["id"]).rlike(r"^[+-]?\d+$"), F.trim(i["id"]).try_cast("bigint").cast("string"))
    return _shaped(df, "remotive", source_id=number, url=F.when(i["url"].rlike("^https?://"), i["url"]), title=i["title"], company=i["company_name"], location_raw=i["candidate_required_location"], remote=F.lit(True), posted_at=parse_time(i["publication_date"]), description=i["description"], tags=F.coalesce(i["tags"], F.array().cast("array<string>")), category=i["category"], employment_type=i["job_type"], salary_raw=F.nullif(i["salary"], F.lit("")))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"arbeitnow": arbeitnow, "themuse": themuse, "jooble": jooble, "adzuna": adzuna, "remotive": remotive}
#: Where a page of each feed holds its postings.
ITEMS = {"arbeitnow": "data", "themuse": "results", "jooble": "jobs", "adzuna": "results", "remotive": "jobs"}
INVALID, NONE = "invalid_response", "no_postings"


def usable_pages(pages: DataFrame, source: str) -> DataFrame:
    """The pages up to the first that is no page of the feed: not JSON, or without a list of postings."""
    listed = F.get_json_object("body", f"$.{ITEMS[source]}").rlike(r"^\s*\[")
    bad = pages.filter(~F.coalesce(listed, F.lit(False))).agg(F.min("page").alias("__bad"))  # one row
    return pages.crossJoin(F.broadcast(bad)).filter(F.col("__bad").isNull() | (F.col("page") < F.col("__bad"))).drop("__bad")


def parsed_run(pages: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The kept postings of a run, the first of an id winning in feed order, and one row of counts.

    A page that is none ends the run. ``error`` is NULL, or why the run gives nothing: its first page is none or no
    posting was usable (invalid_response), or there were none, or none wanted (no_postings). A repeated id is skipped.
    """
    used = usable_pages(pages, source)
    rows = ADAPTERS[source](used)
    first = Window.partitionBy("source_id").orderBy("page", "at")
    wanted = rows.filter("status = 'kept'").withColumn("__n", F.row_number().over(first))
    kept = wanted.filter("__n = 1").select(*COLUMNS)
    repeated = F.when(F.col("status") == "kept", F.row_number().over(Window.partitionBy("source_id", "status").orderBy("page", "at")) > 1).otherwise(False)
    found = F.when(repeated, "skipped").otherwise(F.col("status"))
    counts = rows.withColumn("__s", found).agg(*(F.count_if(F.col("__s") == s).alias(s) for s in ("kept", "filtered", "skipped")), F.count("*").alias("raw_count"))
    n = used.agg(F.count("*").alias("__pages"))
    error = F.when(F.col("kept") > 0, F.lit(None)).when(F.col("__pages") == 0, INVALID).when((F.col("raw_count") == 0) | (F.col("filtered") > 0), NONE).otherwise(INVALID)
    return kept, counts.crossJoin(F.broadcast(n)).withColumn("error", error).drop("__pages")
