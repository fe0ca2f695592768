"""Health, alerts, warnings, failing runs, judged extraction and other small rules over monitoring and evaluation rows."""

from __future__ import annotations

import hashlib
import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the alert rules.
MIN_ANALYSES, FAULT_WARNING, FAULT_CRITICAL, SLOW_P95_MS, TOKENS_MAX = 10, 0.2, 0.5, 60_000, 40_000
FAULT_CODES = ("llm_error", "llm_not_configured", "extraction_invalid")
STATUSES = ("ok", "degraded", "down")
MAX_FAILURES = 5


def safe_part(text: Column) -> Column:
    """Lower case, other characters than ``[a-z0-9_.:-]`` as underscores, at most 64."""
    return F.substring(F.regexp_replace(F.lower(text), r"[^a-z0-9_.:-]", "_"), 1, 64)


def worst(status: str) -> Column:
    """The worst of a group's statuses."""
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.max(F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status)).cast("int")))


def health_alerts(checks: DataFrame) -> DataFrame:
    """An alert a failing check (site, name, status, code): critical if it is down. A code once a site, the worst."""
    found = checks.filter(F.col("status").isin("degraded", "down"))
    code = F.concat(F.lit("check."), safe_part(F.col("name")), F.lit("."), safe_part(F.col("code")))
    return found.groupBy("site", code.alias("alert")).agg(F.when(F.bool_or(F.col("status") == "down"), "critical").otherwise("warning").alias("severity"))


def metric_alerts(metrics: DataFrame) -> DataFrame:
    """Alerts of one row a site: total, ok, faults, n_timed, p95_ms, tokens, denied."""
    rate = F.try_divide(F.col("faults").cast("double"), F.col("total"))
    enough = F.col("total") >= MIN_ANALYSES
    per = F.try_divide(F.col("tokens").cast("double"), F.col("ok"))
    rules = [
        F.when(enough & (rate >= FAULT_WARNING), F.struct(F.lit("service_errors").alias("alert"), F.when(rate >= FAULT_CRITICAL, "critical").otherwise("warning").alias("severity"))),
        F.when((F.col("n_timed") >= MIN_ANALYSES) & (F.col("p95_ms") > SLOW_P95_MS), F.struct(F.lit("slow_analyses").alias("alert"), F.lit("warning").alias("severity"))),
        F.when((F.col("ok") >= MIN_ANALYSES) & (per > TOKENS_MAX), F.struct(F.lit("token_spike").alias("alert"), F.lit("warning").alias("severity"))),
        F.when(F.col("denied") > 0, F.struct(F.lit("limiter_failing").alias("alert"), F.lit("warning").alias("severity"))),
    ]
    return metrics.select("site", F.explode(F.array_compact(F.array(*rules))).alias("a")).select("site", "a.*")


def is_fault(key: Column) -> Column:
    """Whether an error key (stage:code, or unexpected) is the service's own fault."""
    return (key == "unexpected") | F.element_at(F.split(key, ":"), -1).isin(*FAULT_CODES)


def run_until_failing(rows: DataFrame, by: str, order: list[str], failed: Column, most: int = MAX_FAILURES) -> DataFrame:
    """``done``: whether a run of each group reached the row, which ends after ``most`` failures in a row."""
    w = Window.partitionBy(by).orderBy(*order)
    last = F.sum(F.when(failed, 1).otherwise(0)).over(w.rowsBetween(1 - most, 0))
    df = rows.withColumns({"__n": F.row_number().over(w), "__last": last})
    return df.withColumn("done", F.coalesce(F.min(F.when(F.col("__last") == most, F.col("__n"))).over(Window.partitionBy(by)) >= F.col("__n"), F.lit(True))).drop("__n", "__last")


def judged(verdicts: DataFrame, missed: DataFrame, by: list[str]) -> DataFrame:
    """Rates of judged items (by, verdict: supported, partly_wrong, unsupported) and of missed ones."""
    v = verdicts.groupBy(*by).agg(F.count("*").alias("judged"), *(F.count_if(F.col("verdict") == x).alias(x) for x in ("supported", "partly_wrong", "unsupported")))
    m = missed.groupBy(*by).agg(F.count("*").alias("missed"))
    df = v.join(m, by, "full").na.fill(0, ["judged", "supported", "partly_wrong", "unsupported", "missed"])

    def rate(a: Column, b: Column) -> Column:
        return F.round(F.try_divide(a.cast("double"), b), 4)

    return df.withColumns({"supported_rate": rate(F.col("supported"), F.col("judged")), "error_rate": rate(F.col("partly_wrong") + F.col("unsupported"), F.col("judged")), "miss_rate": rate(F.col("missed"), F.col("judged") + F.col("missed"))})


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Each inner interval (key, id, start, end) with the first outer one (key, outer_id, from, to) that holds it, or NULL."""
    hit = inner.join(outer, key).filter("from <= start AND end <= to").groupBy(key, "id").agg(F.min(F.struct("from", "outer_id")).alias("o"))
    return inner.join(hit, [key, "id"], "left").select(key, "id", F.col("o.outer_id").alias("outer_id"))


def multiset_matches(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """True and false positives and misses of groups whose members are equal or not: as many match as both sides have."""
    a, b = (df.groupBy(*by).agg(F.count("*").alias(n)) for df, n in ((predicted, "p"), (gold, "g")))
    both = a.join(b, by, "full").na.fill(0, ["p", "g"])
    return both.select(*by, F.least("p", "g").alias("tp"), (F.col("p") - F.least("p", "g")).alias("fp"), (F.col("g") - F.least("p", "g")).alias("fn"))


def keyed_hash(text: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text, in the JVM."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), text.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


@F.pandas_udf(StringType())
def _network(s: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            found = ipaddress.IPv6Address(text.strip())
        except (ValueError, AttributeError):
            return None
        return str(found.ipv4_mapped or ipaddress.IPv6Address(int(found) >> 64 << 64))

    return s.map(one)


def subject(address: Column, secret: bytes) -> Column:
    """The keyed hash that stands for an address, of its /64 network if it is IPv6; NULL if it is no address."""
    part = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    plain = F.trim(address).rlike(rf"^{part}(?:\.{part}){{3}}$")
    return keyed_hash(F.when(plain, F.trim(address)).otherwise(_network(F.when(~plain, address))), secret)


def file_hash(text: Column) -> Column:
    """SHA-256 of a text whose line ends are those of any system."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)
