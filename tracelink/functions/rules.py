"""Auditable keyword rules: patterns as plain text, matched in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelink.functions.text import col, squash

# Patterns and names that decide the awards' and patents' classes.
AI_CONTEXT = (
    r"\b(neural|machine learning|deep learning|artificial intelligence|\bAI\b|transformer|language model|embedding|fine[- ]?tun|pretrain|"
    r"pre[- ]?train|inference|dataset|training data|computer vision|natural language|LLM)\b"
)
AI_CONTEXT_SHORT = (
    r"\b(neural|machine learning|deep learning|artificial intelligence|language model|embedding|training data|dataset|inference|"
    r"computer vision|natural language)\b"
)
ELECTRICAL = r"\b(voltage|winding|transformer\s+(core|oil|station)|power\s+transformer|magnetic|kVA|step[- ]down|step[- ]up|rectifi)"
CIVILIAN = ("HEALTH", "HHS", "NASA", "AERONAUTICS", "ENERGY", "SCIENCE FOUNDATION", "NSF")
SURVEILLANCE_CLASSES = r"G10L17|G06V40|G08B13|G07C9|H04N7/18"
DEFENCE_ASSIGNEE = (
    r"military|defen[cs]e|army|navy|air force|national security|lockheed|raytheon|northrop|thales|bae systems|general dynamics|leidos|"
    r"booz allen|palantir|hrl laboratories|sandia|los alamos|livermore|triad national|mitre|anduril|elbit|rafael|intelligence|homeland|"
    r"academy of military"
)
LABEL_DOMAIN = ("surveillance", "military_defense", "dual_use_ambiguous", "neither")
STRATA = ("model_surveillance", "model_military", "model_dual_use", "neither_surv_ipc", "neither_other")


def any_of(patterns: Sequence[str]) -> str:
    """One pattern that matches where any of the patterns does, without regard to case in all of Unicode."""
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def matches(c: Column | str, *patterns: str) -> Column:
    return F.coalesce(col(c).rlike(any_of(patterns)), F.lit(False))


def load_rules(text: str) -> dict[str, list[str]]:
    """Reads the small subset of YAML that rule files use: names, each with a list of patterns, and comments."""
    rules: dict[str, list[str]] = {}
    name = None
    for raw in text.splitlines():
        line = re.sub(r"^\s*#.*$", "", raw).rstrip()
        if m := re.fullmatch(r"([\w-]+):\s*", line):
            name = m[1]
            rules[name] = []
        elif name and (m := re.fullmatch(r"\s*-\s*(.+?)\s*", line)):
            quoted = re.match(r"(['\"])(.*?)\1\s*(?:#.*)?$", m[1])
            rules[name].append(quoted[2] if quoted else re.sub(r"\s+#.*$", "", m[1]))
    return {k: v for k, v in rules.items() if v}


def tag(rows: DataFrame, rules: Mapping[str, Sequence[str]], text: Column) -> DataFrame:
    """One row for each rule that matches a row (tag): every text is scanned in one projection, with all rules."""
    hits = F.array(*[F.when(text.rlike(any_of(p)), F.lit(name)) for name, p in rules.items()])
    return rows.withColumn("tag", F.explode(F.array_compact(hits)))


def term_levels(rows: DataFrame, terms: Mapping[str, str], text: str = "text", context: str = AI_CONTEXT) -> DataFrame:
    """For each term the rows at three levels: raw (its first word, or all of it, is in the text), boundary (its pattern
    matches as well) and strict (a context word is there too). raw over-counts terms of several words; do not quote it."""
    low, parts = F.lower(F.col(text)), []
    in_context = F.col(text).rlike(f"(?iu){context}")
    for name, pattern in terms.items():
        raw = low.contains(name.split()[0]) | low.contains(name)
        hit = raw & F.col(text).rlike(f"(?iu){pattern}")
        parts.append(F.struct(F.lit(name).alias("term"), raw.alias("raw"), hit.alias("boundary"), (hit & in_context).alias("strict")))
    flags = rows.select(F.explode(F.array(*parts)).alias("f")).select("f.*")
    return flags.groupBy("term").agg(*[F.count_if(c).alias(c) for c in ("raw", "boundary", "strict")])


def snippet(text: Column | str, pattern: str, around: int = 90) -> Column:
    """The first match with `around` characters on both sides, white space collapsed; null without a match."""
    whole = f"(?iu){pattern}"
    at = F.regexp_instr(col(text), F.lit(whole))
    size = F.length(F.regexp_substr(col(text), F.lit(whole)))
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, squash(F.substring(col(text), begin, at - begin + size + around)))


def agency_arm(agency: Column | str) -> Column:
    """defence, else civilian, else null. WAR is tested as a bare substring, as in the published counts."""
    a = F.upper(F.coalesce(col(agency), F.lit("")))
    defence = a.contains("DEFENSE") | a.isin("DOD", "DOW") | a.contains("WAR")
    civilian = F.lit(False)
    for name in CIVILIAN:
        civilian = civilian | a.contains(name)
    return F.when(defence, "defence").when(civilian, "civilian")


def is_homonym(method: Column | str, text: Column | str) -> Column:
    """An electrical transformer."""
    return (col(method) == "transformer") & matches(text, ELECTRICAL) & ~matches(text, AI_CONTEXT_SHORT)


def has_surveillance_class(classes: Column | str) -> Column:
    return F.coalesce(col(classes).rlike(SURVEILLANCE_CLASSES), F.lit(False))


def stratum(label: Column | str, surveillance_class: Column) -> Column:
    """The label decides first, then the examiner's class."""
    return (
        F.when(col(label) == LABEL_DOMAIN[0], STRATA[0])
        .when(col(label) == LABEL_DOMAIN[1], STRATA[1])
        .when(col(label) == LABEL_DOMAIN[2], STRATA[2])
        .when(surveillance_class, STRATA[3])
        .otherwise(STRATA[4])
    )


def sounds_of_defence(assignee: Column | str) -> Column:
    return matches(assignee, DEFENCE_ASSIGNEE)
