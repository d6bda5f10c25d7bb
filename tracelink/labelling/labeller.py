"""Labelling records with a pluggable labeller, cached by content.

A labeller maps prompts to raw responses. Responses are parsed strictly: a label counts only if the outermost braces hold
one JSON object whose label is in the domain. Errors are not cached, so an absent record is never mistaken for one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.functions.ids import content_key
from tracelink.functions.rules import LABEL_DOMAIN
from tracelink.functions.text import render

TEMPLATE = "Title: {title}\nAssignee: {assignee}\nAbstract: {abstract}\nAnswer with one JSON object: label, confidence, rationale, insufficient_info."

Labeller = Callable[[Sequence[str]], Sequence[str | None]]


def rule_labeller(rules: Mapping[str, str], default: str = "neither") -> Labeller:
    """A deterministic labeller: the first label whose pattern matches the prompt's abstract and title."""
    compiled = [(label, re.compile(pattern, re.I)) for label, pattern in rules.items()]

    def label(prompts: Sequence[str]) -> list[str]:
        out = []
        for prompt in prompts:
            hit = next(((name, m[0]) for name, rx in compiled if (m := rx.search(prompt))), (default, ""))
            out.append(json.dumps({"label": hit[0], "confidence": 2 if hit[1] else 1, "rationale": hit[1], "insufficient_info": "(none)" in prompt}))
        return out

    return label


PARSED = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("confidence", T.IntegerType()), T.StructField("rationale", T.StringType()), T.StructField("insufficient_info", T.BooleanType())]
)


@F.pandas_udf(PARSED)
def parse_response(raw: pd.Series) -> pd.DataFrame:
    """The object between the first { and the last }, if that is one JSON object and nothing else."""
    out = []
    for s in raw:
        m = re.search(r"\{.*\}", s, re.S) if isinstance(s, str) else None
        try:
            found = json.loads(m[0]) if m else None
        except ValueError:
            found = None
        found = found if isinstance(found, dict) else {}
        c, i, label, why = (found.get(k) for k in ("confidence", "insufficient_info", "label", "rationale"))
        out.append((label if isinstance(label, str) else None, c if isinstance(c, int) and not isinstance(c, bool) else None, why if isinstance(why, str) else None, i if isinstance(i, bool) else None))
    frame = pd.DataFrame(out, columns=["label", "confidence", "rationale", "insufficient_info"])
    return frame.astype({"confidence": "Int64", "insufficient_info": "boolean"})


def prompt(redact: bool = True) -> Column:
    """The prompt of a record; redact hides the assignee from the labeller, not from the output."""
    return render(TEMPLATE, title="title", assignee=F.lit("(redacted)") if redact else "assignee", abstract="abstract")


def usable(records: DataFrame) -> DataFrame:
    """Records with a title or an abstract."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return records.where(filled("title") | filled("abstract"))


def misses(records: DataFrame, cache: DataFrame, model: str, redact: bool = True) -> DataFrame:
    """Records (with key and prompt) whose response is not in the cache (key, raw)."""
    keyed = usable(records).withColumn("prompt", prompt(redact)).withColumn("key", content_key(F.lit(model), "prompt"))
    return keyed.join(cache.select("key"), "key", "left_anti")


def respond(missing: DataFrame, labeller: Labeller, tries: int = 5, distinct: bool = False) -> DataFrame:
    """(key, raw) of each missing prompt once, to append to the cache. distinct: no key occurs twice in missing.

    Prompts that fail (None) are asked again, `tries` times in all; what fails then is left out, so it is asked in the next run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [None] * len(batch)
            prompts = list(batch["prompt"])
            for _ in range(tries):
                left = [i for i, r in enumerate(raw) if r is None]
                if not left:
                    break
                for i, r in zip(left, labeller([prompts[i] for i in left])):
                    raw[i] = r
            yield pd.DataFrame({"key": batch["key"], "raw": raw})

    rows = missing.select("key", "prompt")
    return (rows if distinct else rows.dropDuplicates(["key"])).mapInPandas(run, "key string, raw string").where("raw IS NOT NULL")


def within_budget(missing: DataFrame, cost: Column, most: float) -> DataFrame:
    """The prompts (key, prompt) that are asked before the cost reaches `most`, in order of key, with cost and spent (the
    sum before each).

    Costs are summed by the first three digits of the md5 key, and only then inside of these, so no task orders all prompts.
    """
    rows = missing.select("key", "prompt").dropDuplicates(["key"]).select("key", "prompt", cost.cast("double").alias("cost"), F.substring("key", 1, 3).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 rows at most
    parts = rows.groupBy("part").agg(F.sum("cost").alias("total")).withColumn("earlier", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    inside = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("earlier") + F.coalesce(F.sum("cost").over(inside), F.lit(0.0))
    return rows.join(F.broadcast(parts.select("part", "earlier")), "part").withColumn("spent", spent).where(F.col("spent") <= most).select("key", "prompt", "cost", "spent")


def labels(records: DataFrame, cache: DataFrame, model: str, redact: bool = True, domain: Sequence[str] = LABEL_DOMAIN) -> DataFrame:
    """Labels of the records whose response is cached, with schemas.LABELS' columns; a label outside of the domain is
    null and keeps its response in unparsed."""
    keyed = usable(records).withColumn("prompt", prompt(redact)).withColumn("key", content_key(F.lit(model), "prompt"))
    found = keyed.join(cache, "key").withColumn("p", parse_response("raw"))
    good = F.coalesce(F.col("p.label").isin(*domain), F.lit(False))
    return found.select(
        "patent_id", "title", "assignee", "grant_date", F.when(good, F.col("p.label")).alias("label"), "p.confidence", "p.rationale", "p.insufficient_info",
        F.when(~good, F.col("raw")).alias("unparsed"), F.lit(model).alias("model"),
    )
