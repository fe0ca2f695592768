"""Countries named by place texts, as column expressions over a gazetteer.

The gazetteer is a parameter: words of countries, words of regions inside a country and
words of cities. The default knows countries by their English names, the states of the
US and the provinces of Canada; cities are given by the caller.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ISO codes with names, the English one first.
COUNTRIES = {
    "AL": ("Albania",),
    "DZ": ("Algeria",),
    "AR": ("Argentina",),
    "AM": ("Armenia",),
    "AU": ("Australia",),
    "AT": ("Austria", "österreich"),
    "AZ": ("Azerbaijan",),
    "BH": ("Bahrain",),
    "BD": ("Bangladesh",),
    "BY": ("Belarus",),
    "BE": ("Belgium", "belgique"),
    "BA": ("Bosnia and Herzegovina", "bosnia"),
    "BR": ("Brazil", "brasil"),
    "BG": ("Bulgaria",),
    "CA": ("Canada",),
    "CL": ("Chile",),
    "CN": ("China",),
    "CO": ("Colombia",),
    "CR": ("Costa Rica",),
    "HR": ("Croatia", "hrvatska"),
    "CY": ("Cyprus",),
    "CZ": ("Czechia", "czech republic"),
    "DK": ("Denmark", "danmark"),
    "DO": ("Dominican Republic",),
    "EC": ("Ecuador",),
    "EG": ("Egypt",),
    "EE": ("Estonia", "eesti"),
    "ET": ("Ethiopia",),
    "FI": ("Finland", "suomi"),
    "FR": ("France",),
    "GE": ("Georgia",),
    "DE": ("Germany", "deutschland", "німеччина"),
    "GR": ("Greece",),
    "HK": ("Hong Kong",),
    "HU": ("Hungary",),
    "IS": ("Iceland",),
    "IN": ("India",),
    "ID": ("Indonesia",),
    "IR": ("Iran",),
    "IQ": ("Iraq",),
    "IE": ("Ireland",),
    "IL": ("Israel",),
    "IT": ("Italy", "italia"),
    "JP": ("Japan",),
    "JO": ("Jordan",),
    "KZ": ("Kazakhstan",),
    "KE": ("Kenya",),
    "KR": ("South Korea", "korea"),
    "KW": ("Kuwait",),
    "LV": ("Latvia",),
    "LB": ("Lebanon",),
    "LT": ("Lithuania",),
    "LU": ("Luxembourg",),
    "MY": ("Malaysia",),
    "MT": ("Malta",),
    "MX": ("Mexico",),
    "MD": ("Moldova",),
    "ME": ("Montenegro",),
    "MA": ("Morocco",),
    "MZ": ("Mozambique",),
    "NL": ("Netherlands", "the netherlands", "holland"),
    "NZ": ("New Zealand",),
    "NG": ("Nigeria",),
    "MK": ("North Macedonia",),
    "NO": ("Norway", "norge"),
    "OM": ("Oman",),
    "PK": ("Pakistan",),
    "PA": ("Panama",),
    "PE": ("Peru",),
    "PH": ("Philippines",),
    "PL": ("Poland", "polska"),
    "PT": ("Portugal",),
    "QA": ("Qatar",),
    "RO": ("Romania",),
    "RU": ("Russia",),
    "SA": ("Saudi Arabia",),
    "RS": ("Serbia",),
    "SG": ("Singapore",),
    "SK": ("Slovakia",),
    "SI": ("Slovenia",),
    "ZA": ("South Africa",),
    "ES": ("Spain", "españa"),
    "LK": ("Sri Lanka",),
    "SE": ("Sweden", "sverige"),
    "CH": ("Switzerland", "schweiz", "suisse"),
    "TW": ("Taiwan",),
    "TH": ("Thailand",),
    "TN": ("Tunisia",),
    "TR": ("Turkey",),
    "UA": ("Ukraine", "україна"),
    "AE": ("United Arab Emirates", "uae"),
    "GB": ("United Kingdom", "uk", "great britain", "england"),
    "US": ("United States", "usa", "united states of america"),
    "UY": ("Uruguay",),
    "VE": ("Venezuela",),
    "VN": ("Vietnam",),
}
US_STATES = {
    "AL": ("Alabama",),
    "AK": ("Alaska",),
    "AZ": ("Arizona",),
    "AR": ("Arkansas",),
    "CA": ("California",),
    "CO": ("Colorado",),
    "CT": ("Connecticut",),
    "DE": ("Delaware",),
    "DC": ("District of Columbia",),
    "FL": ("Florida",),
    "GA": ("Georgia",),
    "HI": ("Hawaii",),
    "ID": ("Idaho",),
    "IL": ("Illinois",),
    "IN": ("Indiana",),
    "IA": ("Iowa",),
    "KS": ("Kansas",),
    "KY": ("Kentucky",),
    "LA": ("Louisiana",),
    "ME": ("Maine",),
    "MD": ("Maryland",),
    "MA": ("Massachusetts",),
    "MI": ("Michigan",),
    "MN": ("Minnesota",),
    "MS": ("Mississippi",),
    "MO": ("Missouri",),
    "MT": ("Montana",),
    "NE": ("Nebraska",),
    "NV": ("Nevada",),
    "NH": ("New Hampshire",),
    "NJ": ("New Jersey",),
    "NM": ("New Mexico",),
    "NY": ("New York",),
    "NC": ("North Carolina",),
    "ND": ("North Dakota",),
    "OH": ("Ohio",),
    "OK": ("Oklahoma",),
    "OR": ("Oregon",),
    "PA": ("Pennsylvania",),
    "RI": ("Rhode Island",),
    "SC": ("South Carolina",),
    "SD": ("South Dakota",),
    "TN": ("Tennessee",),
    "TX": ("Texas",),
    "UT": ("Utah",),
    "VT": ("Vermont",),
    "VA": ("Virginia",),
    "WA": ("Washington",),
    "WV": ("West Virginia",),
    "WI": ("Wisconsin",),
    "WY": ("Wyoming",),
}
CA_PROVINCES = {
    "AB": ("Alberta",),
    "BC": ("British Columbia",),
    "MB": ("Manitoba",),
    "NB": ("New Brunswick",),
    "NL": ("Newfoundland and Labrador",),
    "NS": ("Nova Scotia",),
    "NT": ("Northwest Territories",),
    "NU": ("Nunavut",),
    "ON": ("Ontario",),
    "PE": ("Prince Edward Island",),
    "QC": ("Quebec",),
    "SK": ("Saskatchewan",),
    "YT": ("Yukon",),
}
EU = ("AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE")
EUROPE = (*EU, "AL", "BA", "BY", "CH", "GB", "IS", "MD", "ME", "MK", "NO", "RS", "RU", "UA")
LATAM = ("AR", "BR", "CL", "CO", "CR", "DO", "EC", "MX", "PA", "PE", "UY", "VE")
APAC = ("AU", "BD", "CN", "HK", "ID", "IN", "JP", "KR", "LK", "MY", "NZ", "PH", "PK", "SG", "TH", "TW", "VN")
REGIONS = {
    "europe": EUROPE,
    "eu": EU,
    "european union": EU,
    "eea": (*EU, "IS", "NO"),
    "emea": (*EUROPE, "AE", "AM", "AZ", "BH", "DZ", "EG", "GE", "GH", "IL", "JO", "KE", "KW", "LB", "MA", "NG", "OM", "QA", "SA", "TN", "TR", "ZA"),
    "north america": ("US", "CA", "MX"),
    "latam": LATAM,
    "latin america": LATAM,
    "south america": ("AR", "BR", "CL", "CO", "EC", "PE", "UY", "VE"),
    "americas": ("US", "CA", *LATAM),
    "apac": APAC,
    "asia pacific": APAC,
}
OPEN = ("worldwide", "anywhere", "global", "anywhere in the world")
SEPARATOR = r"[,;/|()\[\]•·–—]|\s-\s"


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.casefold())
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


def _coded(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {fold(name): code for code, names in table.items() for name in names}


@dataclass(frozen=True)
class Gazetteer:
    """Folded word -> code of its country."""

    countries: dict[str, str] = field(default_factory=lambda: _coded(COUNTRIES))
    states: dict[str, str] = field(default_factory=lambda: _coded(US_STATES))
    provinces: dict[str, str] = field(default_factory=lambda: _coded(CA_PROVINCES))
    cities: dict[str, str] = field(default_factory=dict)

    def words(self) -> dict[str, str]:
        """What a folded part names. A word that is a country and a state names nothing."""
        inside = dict.fromkeys(self.states, "US") | dict.fromkeys(self.provinces, "CA")
        found = {fold(c): code for c, code in self.cities.items()} | inside | self.countries
        return {w: code for w, code in found.items() if not (w in self.countries and w in inside)}

    def codes(self) -> dict[str, str]:
        """What a part of two capitals names. A state's code that is a country's too names nothing."""
        states, all_ = set(self.states.values()), set(self.countries.values())
        found = {c: c for c in all_} | dict.fromkeys(self.provinces.values(), "CA") | dict.fromkeys(states, "US")
        return {c: to for c, to in found.items() if not (c in states and c in all_)}

    def unsure(self) -> list[str]:
        return sorted(self.countries.keys() & (self.states.keys() | self.provinces.keys()))


DEFAULT = Gazetteer()


def _lookup(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


@F.pandas_udf(ArrayType(StringType()))
def _folded(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: None if p is None else [fold(x) for x in p])


def _both(parts: Column) -> Column:
    """The folded parts; ASCII stays in the JVM."""
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(p), r"[\t-\r ]+", " ")))
    return F.when(F.array_join(parts, "").rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_folded(parts))


def _code(part: Column, folded: Column, places: Gazetteer) -> Column:
    known, as_code = places.words(), places.codes()
    country_or_state = {w: c for w, c in known.items() if w in places.countries or w in places.states or w in places.provinces}
    city = {w: c for w, c in known.items() if w not in country_or_state}
    named = F.coalesce(_lookup(country_or_state, folded), F.when(part.rlike("^[A-Z]{2}$"), _lookup(as_code, part)).otherwise(_lookup(city, folded)))
    return F.when(~folded.isin(places.unsure()), named)


def resolve_country(text: Column, places: Gazetteer = DEFAULT) -> Column:
    """The code of the one country that the text names; NULL if it names none or several."""
    parts = F.transform(F.split(text, SEPARATOR), lambda p: F.trim(p))
    codes = F.array_distinct(F.array_compact(F.zip_with(parts, _both(parts), lambda p, f: _code(p, f, places))))
    return F.when(F.size(codes) == 1, F.get(codes, 0))


def allowed_countries(text: Column, places: Gazetteer = DEFAULT) -> Column:
    """Sorted codes that a remote posting is limited to; NULL if open, empty, or a part is unknown."""
    parts = F.transform(F.split(text, SEPARATOR), lambda p: F.trim(F.regexp_replace(p, r"(?i)\b(?:only|based)\b", " "), F.lit(" -")))
    regions = F.create_map(*(x for w, codes in REGIONS.items() for x in (F.lit(w), F.array(*map(F.lit, codes)))))

    def codes(part: Column, folded: Column) -> Column:
        nothing = F.array().cast("array<string>")
        one = _code(part, folded, places)
        return F.when(folded.isin("", "remote"), nothing).when(folded.isin(*OPEN), F.lit(None)).otherwise(F.coalesce(F.try_element_at(regions, folded), F.when(one.isNotNull(), F.array(one))))

    found = F.zip_with(parts, _both(parts), codes)
    every = F.array_sort(F.array_distinct(F.flatten(found)))  # NULL where one part is
    return F.when(F.size(every) > 0, every)


def country_name(code: Column) -> Column:
    names = {c: spelled[0] for c, spelled in COUNTRIES.items()}
    return _lookup(names, F.upper(code))
