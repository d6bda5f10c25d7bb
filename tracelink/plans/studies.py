"""Queries of the planned analyses, orders of all rows and the stored cache, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions.ids import content_key
from tracelink.labelling import labeller
from tracelink.labelling.cache import ResponseCache
from tracelink.operators import claims
from tracelink.operators.ablation import threshold_ablation
from tracelink.operators.ordering import Ordered, plain
from tracelink.operators.titles import ACCENTS, PLAIN, match_titles
from tracelink.plans.queries import edges, or_minus, papers, r6, rated, t
from tracelink.session import shared_folder
from tracelink.stats.correlation import spearman
from tracelink.stats.trend import logistic_trend


def grant_trend(s, d):
    """Whether examiners' citations become more frequent with the year, errors clustered by patent."""
    rows = edges(s, d).join(papers(s, d), "oaid").withColumns({"hit": F.col("reftype") == "R", "year": F.col("year") - 1995})
    out = logistic_trend(rows, "hit", "year", "patent")
    return out.select("term", *[r6(c).alias(c) for c in ("estimate", "error", "z", "odds_ratio", "low", "high")], "n", "clusters")


def _titles(s, d) -> DataFrame:
    return t(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("paper"), F.col("text").alias("title"), (F.col("conv_id") % 7 + 1990).alias("year"))


def title_fallback(s, d):
    """Papers with damaged titles or years against the works they come from."""
    works = _titles(s, d).withColumnRenamed("paper", "work")
    k = F.col("paper") % 6
    damaged = (
        F.when(k == 1, F.expr("concat(replace(title, ' ', ' - '), ' !')"))
        .when(k == 2, F.concat(F.expr("left(title, 3)"), F.expr("substring(title, 5)")))
        .when(k == 3, F.concat(F.expr("left(title, 2)"), F.lit("q"), F.expr("substring(title, 3)")))
        .when(k == 4, F.concat(F.lit("zzz"), F.col("title")))
        .otherwise(F.col("title"))
    )
    wanted = _titles(s, d).withColumns({"title": damaged, "year": F.col("year") + F.when(k == 5, 1).otherwise(0)})
    out = match_titles(wanted, works, "paper", "title", "year", "work")
    return out.withColumns({c: or_minus(c) for c in ("work", "distance")})


def rank_correlation(s, d):
    rows = t(s, d, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("x"), F.col("l_extendedprice").alias("y"))
    return spearman(rows, "x", "y").select("n", *[r6(c).alias(c) for c in ("rho", "low", "high")])


def confidence_ablation(s, d):
    """Distinct patents by confidence, over all links, those in the text, and applicants'."""
    in_text, applicant = F.col("wherefound") == "O", F.col("reftype") == "A"
    settings = {"all": F.lit(True), "in_text": in_text, "applicant": applicant, "in_text_applicant": in_text & applicant}
    return threshold_ablation(edges(s, d), "patent", "confscore", settings, range(1, 51)).withColumn("share", r6("share"))


ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def all_rows_in_order(s, d):
    """The place of every edge by date, and how many citations there were up to it."""
    rows = Ordered(t(s, d, "lineitem").select(*ORDER), *ORDER)
    out = rows.running(rows.numbered("place"), "l_quantity", "upto")
    return plain(out).select("l_orderkey", "l_linenumber", "l_partkey", "place", "upto")


def _rules_but(failing: str, default: str) -> labeller.Labeller:
    """Labels by rule; prompts that hold `failing` get no answer."""

    def label(prompts):
        rules = labeller.rule_labeller({"surveillance": r"licen[cs]e"}, default)
        return [None if failing and failing in p else r for p, r in zip(prompts, rules(prompts))]

    return label


def stored_responses(s, d):
    """Two runs over one cache: what fails in the first is asked in the second, and what it has stored stays."""
    folder = f"{shared_folder(s)}/tracelink/responses-{uuid.uuid4().hex}"
    cache = ResponseCache(s, folder, digits=1)
    docs = t(s, d, "documents").select("doc_id", F.lit("x").alias("title"), F.lit("y").alias("assignee"), F.col("text").alias("abstract"))
    keyed = docs.withColumn("prompt", labeller.prompt()).withColumn("key", content_key(F.lit("rules"), "prompt"))
    half = max(1, -(-keyed.count() // 2))
    cache.fill(keyed, _rules_but("!!", "neither"), half, tries=1)
    cache.fill(keyed, _rules_but("", "dual_use_ambiguous"), half)
    cache.compact()
    keyed.select("doc_id", "key").write.parquet(f"{folder}-keys")  # prompts are made no more than once for it
    keys = s.read.schema("doc_id long, key string").parquet(f"{folder}-keys")
    return keys.join(cache.find(keys), "key").select("doc_id", labeller.parse_response("raw")["label"].alias("label"))


def _claims(s) -> DataFrame:
    """Published numbers: of links, of rates by language, and one that nothing measures. Fixed values."""
    rows = [
        ("one link in three is an applicant's", "applicant_pct", 33.0, 0), ("half of the links are in the text", "in_text_pct", 50.0, 0), ("most links are sure", "confident_pct", 99.9, 1), ("mean confidence", "mean_score", 25.5, 1),
        ("patents, to the nearest thousand", "patents", 2000.0, -3), ("a tenth of German texts is toxic", "toxic_pct[de]", 10.0, 0), ("good English texts", "good_pct[en]", 90.0, -1), ("Latin texts", "toxic_pct[la]", 1.0, 0), ("nobody measures this", "readers", 7.0, 0),
    ]
    return s.createDataFrame(rows, "claim string, metric string, claimed double, decimals int")


def published_claims(s, d):
    """V1: every claim against what the tables give."""
    pct = lambda c: F.count_if(c) * 100 / F.count("*")
    links = {"applicant_pct": pct(F.col("reftype") == "A"), "in_text_pct": pct(F.col("wherefound") == "O"), "confident_pct": pct(F.col("confscore") >= 5), "mean_score": F.avg("confscore"), "patents": F.countDistinct("patent")}
    found = claims.measured(edges(s, d), links).unionByName(claims.measured_by(rated(s, d), "lang", {"toxic_pct": pct(F.col("toxic") == 1), "good_pct": pct(F.col("quality") == 1)}))
    out = claims.verdicts(_claims(s), found)
    return out.select("claim", "metric", "claimed", F.round(or_minus("value"), 6).alias("value"), "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [grant_trend, title_fallback, rank_correlation, confidence_ablation, all_rows_in_order, stored_responses, published_claims]
    return {f.__name__: f for f in found}


_TITLE = rf"trim(regexp_replace(translate(lower(title), '{ACCENTS}', '{PLAIN}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    found = {
        "grant_trend": """
WITH RECURSIVE e AS (SELECT year(o_orderdate) - 1995 AS year, (l_returnflag = 'R')::INT AS y, l_partkey AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT avg(year) AS m FROM e),
cells AS (SELECT year - m AS x, count(*) AS n, sum(y) AS k FROM e, c GROUP BY year - m),
newton(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT i, a, b, sum(k - n * p) AS g0, sum((k - n * p) * x) AS g1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11
    FROM (SELECT *, 1 / (1 + exp(-a - b * x)) AS p FROM newton, cells WHERE i < 12) GROUP BY i, a, b)),
fit AS (SELECT a, b FROM newton WHERE i = 12),
h AS (SELECT sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11 FROM (SELECT *, 1 / (1 + exp(-a - b * x)) AS p FROM cells, fit)),
s AS (SELECT g, sum(y - p) AS s0, sum((y - p) * x) AS s1, count(*) AS n FROM (SELECT g, y, year - m AS x, 1 / (1 + exp(-a - b * (year - m))) AS p FROM e, c, fit) GROUP BY g),
b AS (SELECT sum(s0 * s0) AS b00, sum(s0 * s1) AS b01, sum(s1 * s1) AS b11, sum(n) AS n, count(*) AS clusters FROM s),
i AS (SELECT h11 / (h00 * h11 - h01 * h01) AS i00, -h01 / (h00 * h11 - h01 * h01) AS i01, h00 / (h00 * h11 - h01 * h01) AS i11 FROM h),
v AS (SELECT n, clusters, clusters / (clusters - 1) * (n - 1) / (n - 2) AS f,
  i00 * i00 * b00 + 2 * i00 * i01 * b01 + i01 * i01 * b11 AS v00, i01 * i01 * b00 + 2 * i01 * i11 * b01 + i11 * i11 * b11 AS v11,
  i00 * i01 * b00 + (i00 * i11 + i01 * i01) * b01 + i01 * i11 * b11 AS v01 FROM b, i),
r AS (SELECT 'intercept' AS term, a - b * m AS estimate, sqrt(f * (v00 - 2 * m * v01 + m * m * v11)) AS error, n, clusters FROM fit, v, c
  UNION ALL SELECT 'year', b, sqrt(f * v11), n, clusters FROM fit, v)
SELECT term, round(estimate, 6) AS estimate, round(error, 6) AS error, round(estimate / error, 6) AS z, round(exp(estimate), 6) AS odds_ratio,
  round(exp(estimate - 1.959963984540054 * error), 6) AS low, round(exp(estimate + 1.959963984540054 * error), 6) AS high, n::BIGINT AS n, clusters FROM r
""",
        "title_fallback": f"""
WITH works AS (SELECT conv_id AS work, {_TITLE} AS t, y FROM (SELECT conv_id, text AS title, conv_id % 7 + 1990 AS y FROM conversations WHERE turn = 0)),
papers AS (SELECT paper, {_TITLE} AS t, y FROM (SELECT conv_id AS paper, conv_id % 7 + 1990 + (conv_id % 6 = 5)::INT AS y,
  CASE conv_id % 6 WHEN 1 THEN replace(text, ' ', ' - ') || ' !' WHEN 2 THEN left(text, 3) || substring(text, 5) WHEN 3 THEN left(text, 2) || 'q' || substring(text, 3) WHEN 4 THEN 'zzz' || text ELSE text END AS title
  FROM conversations WHERE turn = 0)),
c AS (SELECT paper, work, levenshtein(p.t, w.t) AS distance, abs(p.y - w.y) AS gap FROM papers p JOIN works w ON w.y BETWEEN p.y - 1 AND p.y + 1
  AND abs(length(p.t) - length(w.t)) <= 1 WHERE p.t <> '' AND w.t <> '' AND levenshtein(p.t, w.t) <= 1),
b AS (SELECT *, rank() OVER (PARTITION BY paper ORDER BY distance, gap) AS r FROM c),
f AS (SELECT paper, distance, count(*) AS n, min(work) AS w FROM b WHERE r = 1 GROUP BY paper, distance)
SELECT paper, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 THEN w ELSE -1 END AS work, coalesce(distance, -1)::INT AS distance, coalesce(n, 0) AS candidates FROM papers LEFT JOIN f USING (paper)
""",
        "rank_correlation": """
WITH v AS (SELECT CASE WHEN l_linenumber < 7 THEN l_quantity END AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM k),
w AS (SELECT *, 1.959963984540054 * sqrt((1 + rho * rho / 2) / (n - 3)) AS width FROM s)
SELECT n, round(rho, 6) AS rho, round(tanh(atanh(rho) - width), 6) AS low, round(tanh(atanh(rho) + width), 6) AS high FROM w
""",
        "confidence_ablation": """
WITH g AS (SELECT unnest(range(1, 51)) AS threshold),
x AS (SELECT unnest(['all', 'in_text', 'applicant', 'in_text_applicant']) AS setting),
e AS (SELECT setting, l_partkey AS p, l_quantity AS q FROM lineitem, x WHERE (setting NOT LIKE '%in_text%' OR l_linestatus = 'O') AND (setting NOT LIKE '%applicant%' OR l_returnflag = 'A')),
a AS (SELECT setting, count(DISTINCT p) AS total FROM e GROUP BY setting)
SELECT setting, threshold::DOUBLE AS threshold, count(DISTINCT p) FILTER (q >= threshold) AS n, any_value(total) AS total, round(count(DISTINCT p) FILTER (q >= threshold) / any_value(total), 6) AS share
FROM e JOIN a USING (setting), g GROUP BY setting, threshold
""",
        "all_rows_in_order": f"""
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS place, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM lineitem
WINDOW w AS (ORDER BY {', '.join(ORDER)})
""",
        "published_claims": """
WITH c(claim, metric, claimed, decimals) AS (VALUES ('one link in three is an applicant''s', 'applicant_pct', 33.0, 0), ('half of the links are in the text', 'in_text_pct', 50.0, 0), ('most links are sure', 'confident_pct', 99.9, 1),
  ('mean confidence', 'mean_score', 25.5, 1), ('patents, to the nearest thousand', 'patents', 2000.0, -3), ('a tenth of German texts is toxic', 'toxic_pct[de]', 10.0, 0), ('good English texts', 'good_pct[en]', 90.0, -1),
  ('Latin texts', 'toxic_pct[la]', 1.0, 0), ('nobody measures this', 'readers', 7.0, 0)),
l AS (SELECT unnest(['applicant_pct', 'in_text_pct', 'confident_pct', 'mean_score', 'patents']) AS metric,
  unnest([100 * avg((l_returnflag = 'A')::INT), 100 * avg((l_linestatus = 'O')::INT), 100 * avg((l_quantity >= 5)::INT), avg(l_quantity), count(DISTINCT l_partkey)]) AS value FROM lineitem),
g AS (SELECT unnest(['toxic_pct[', 'good_pct[']) || lang || ']' AS metric, unnest([100 * avg((toxic = 1)::INT), 100 * avg((quality = 1)::INT)]) AS value FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang),
m AS (SELECT * FROM l UNION ALL SELECT * FROM g)
SELECT claim, c.metric, claimed::DOUBLE AS claimed, round(coalesce(value, -1), 6)::DOUBLE AS value,
  CASE WHEN value IS NULL THEN 'missing' WHEN floor(value * pow(10, decimals) + 0.5 + 1e-9) = floor(claimed * pow(10, decimals) + 0.5 + 1e-9) THEN 'ok' ELSE 'failed' END AS verdict FROM c LEFT JOIN m ON c.metric = m.metric
""",
        "stored_responses": """
SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)licen[cs]e') THEN 'surveillance' WHEN contains(coalesce(text, ''), '!!') THEN 'dual_use_ambiguous' ELSE 'neither' END AS label FROM documents
""",
    }
    return found
