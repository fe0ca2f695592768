"""Text functions as column expressions; Arrow functions only where Spark has none (NFKC)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a mention of each industry.
NICHES = {
    "gambling": r"casino\w*|kasino\w*|казино\b|gambl(?:ing|ers?)\b|sports?[- ]?books?\b|(?:sports?|online) betting\b|betting (?:site|app|compan|platform|operator|market)\w*|bookmak(?:er|ers|ing)\b|wagering\b|i-?gaming\b|poker\b|slot (?:machine|game)s?\b|online slots\b|bingo\b|gl(?:ü|u|ue)cksspiel\w*|sportwetten\b|wettanbieter\w*|букмекер\w*|гемблінг\w*|азартн\w+ гр\w+|ставки на спорт\w*",
    "crypto": r"crypto-?currenc(?:y|ies)\b|crypto\b|cryptos\b|bitcoin\w*|ethereum\b|blockchain\w*|web ?3\b|defi\b|nfts?\b|stablecoins?\b|altcoins?\b|smart contracts?\b|solidity\b|kryptow(?:ä|ae|a)hrung\w*|krypto\b|криптовалют\w*|блокчейн\w*|біткоїн\w*|крипто(?:біржа\w*|\b)",
    "forex": r"forex\b|binary options?\b|cfd trading\b|contracts? for difference\b|spread betting\b|форекс\w*|бінарн\w+ опціон\w*",
    "adult": r"porn\w*|adult (?:content|entertainment|industry|videos?|sites?|platform)\b|onlyfans\b|nsfw\b|sex toys?\b|erotic\w*|cam (?:sites?|models?)\b|erotik\b|порно\w*|еротичн\w*",
    "mlm": r"multi-?level marketing\b|network marketing\b|mlms?\b|downlines?\b|мережев\w+ маркетинг\w*",
}
MAX_URL = 2048


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, lower case, white space as single spaces; punctuation stays."""
    return s.str.normalize("NFKC").str.lower().str.split().str.join(" ")


def normalize(col: Column) -> Column:
    """ASCII texts stay in the JVM; others go through Arrow."""
    plain = F.trim(F.regexp_replace(F.lower(col), r"[\t-\r\x1c-\x1f ]+", " "))
    return F.when(col.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(nfkc(col))


@F.pandas_udf(StringType())
def nfkc_lines(s: pd.Series) -> pd.Series:
    """NFKC, lower case, each line with single spaces."""
    low = s.str.normalize("NFKC").str.lower()
    spaced = low.str.contains(" ", regex=False, na=False)
    low[spaced] = low[spaced].map(lambda t: "\n".join(" ".join(line.split()) for line in t.split("\n")))
    return low


def normal_words(text: Column, words: Column) -> Column:
    """The normal form (see ``normalize``) of each of a text's words, which hold no white space. Words of ASCII texts stay in the
    JVM, those of others go through Arrow, a row a text and not a row a word."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    whole = F.array_join(words, "\n")
    return F.when(F.size(words) == 0, words).otherwise(F.split(F.when(plain, F.lower(whole)).otherwise(nfkc_lines(F.when(~plain, whole))), "\n"))


def niches(head: Column, text: Column) -> Column:
    """Codes of the industries that the head names, or the head and text together name twice or more."""
    both = F.concat_ws(" ", head, text)

    def code(name: str) -> Column:
        pattern = F.lit(r"(?iU)\b(?:" + NICHES[name] + ")")
        return F.when((F.regexp_count(F.coalesce(head, F.lit("")), pattern) >= 1) | (F.regexp_count(both, pattern) >= 2), F.lit(name))

    return F.array_compact(F.array(*(code(n) for n in NICHES)))


def safe_url(url: Column) -> Column:
    """The address if it is http(s), has a host, no white space or control, and is not too long; else NULL."""
    ok = (F.length(url) <= MAX_URL) & ~url.rlike(r"[\s\x00-\x1f]") & url.rlike(r"^(?i)https?://[^/?#@:]+|^(?i)https?://[^/?#]*@[^/?#:]+")
    return F.when(ok, url)


def stable_id(link: Column) -> Column:
    return F.substring(F.sha2(link, 256), 1, 20)


def percent(share: Column) -> Column:
    """A share as a whole percent, halves up."""
    return F.when(share.isNotNull(), F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")))


def plural(n: Column, word: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(word)).otherwise(F.lit(many or word + "s")))


def text_or_none(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))
