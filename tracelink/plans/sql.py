"""The queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from tracelink.functions.rules import AI_CONTEXT_SHORT, ELECTRICAL
from tracelink.plans.queries import BUCKETS, RULES, TERMS

_PAPERS = "papers AS (SELECT o_orderkey AS oaid, year(o_orderdate)::INT AS year, o_orderpriority AS venue FROM orders)"
_EDGES = (
    "edges AS (SELECT l_orderkey AS oaid, l_partkey AS patent, l_returnflag AS reftype, l_linestatus AS wherefound, l_quantity AS confscore, "
    "l_suppkey AS arm_key, l_linenumber AS ord FROM lineitem)"
)


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


#: DuckDB's \b is of ASCII; these patterns meet no other letters at their edges but in the two rules on words.
def _word(p: str) -> str:
    return p.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])") if r"\b" in p else p


_TAGS = "tagged AS (" + " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{name}' AS tag FROM documents WHERE regexp_matches(text, '{_word(_any(p))}', 'i')" for name, p in RULES.items()
) + ")"
_BUCKET = "CASE " + " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in BUCKETS) + " END"
_PATENT = (
    "CASE WHEN p_partkey % 7 = 0 THEN 'us-d' || lpad(p_partkey::VARCHAR, 7, '0') || '-s1' WHEN p_partkey % 7 = 1 THEN ' us-2015' || lpad(p_partkey::VARCHAR, 7, '0') || '-a1' "
    "WHEN p_partkey % 7 = 2 THEN 'garbage' ELSE 'us-' || (p_partkey * 6151)::VARCHAR || '-b2' END"
)
_ERA = f"""raw AS (SELECT p_partkey, {_PATENT} AS raw FROM part),
norm AS (SELECT p_partkey, raw, upper(replace(trim(raw), '-', '')) AS pid FROM raw),
cut AS (SELECT *, regexp_extract(pid, '^US([A-Z]*)0*([0-9]+)', 1) AS kind, regexp_extract(pid, '^US([A-Z]*)0*([0-9]+)', 2) AS digits FROM norm),
eras AS (SELECT *, CASE WHEN digits = '' OR kind <> '' THEN 'design/other' WHEN length(digits) >= 10 THEN 'application' WHEN digits::BIGINT < 3930271 THEN 'pre-1976'
  WHEN digits::BIGINT < 8925000 THEN '1976-2014' WHEN digits::BIGINT < 11000000 THEN '2015-May2021' ELSE 'May2021+' END AS era FROM cut)"""
_STRATA = """rated AS (SELECT d.doc_id, quality, toxic, source, CASE WHEN toxic = 1 THEN 'surveillance' WHEN quality = 0 THEN 'military_defense' ELSE 'neither' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
strata AS (SELECT *, CASE WHEN label = 'surveillance' THEN 'model_surveillance' WHEN label = 'military_defense' THEN 'model_military'
  WHEN source IN ('src0', 'src3') THEN 'neither_surv_ipc' ELSE 'neither_other' END AS stratum FROM rated),
picked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('2026:' || doc_id), doc_id) AS place FROM strata),
sample AS (SELECT * FROM picked WHERE stratum IN ('model_surveillance', 'model_military') OR (stratum = 'neither_surv_ipc' AND place <= 20) OR (stratum = 'neither_other' AND place <= 60))"""
_WEIGHTS = """weights AS (SELECT stratum, population, sample, population / sample AS weight FROM (SELECT stratum, count(*) AS population FROM strata GROUP BY 1)
  JOIN (SELECT stratum, count(*) AS sample FROM sample GROUP BY 1) USING (stratum))"""
_ARMS = f"""{_EDGES},
arms AS (SELECT CASE WHEN patent <= 500 THEN 'old' WHEN patent <= 1500 THEN 'middle' WHEN patent <= 1000000 THEN 'new' ELSE 'none' END AS era, reftype = 'R' AS t, confscore > 47 AS hit FROM edges),
grid AS (SELECT unnest(['old', 'middle', 'new', 'none']) AS era),
cells AS (SELECT grid.era, count(*) FILTER (t AND hit) AS k1, count(*) FILTER (t) AS n1, count(*) FILTER (NOT t AND hit) AS k0, count(*) FILTER (NOT t) AS n0
  FROM grid LEFT JOIN arms ON grid.era = arms.era GROUP BY 1)"""
_FLIPS = """rated AS (SELECT d.doc_id, lang, 'a' AS orig, CASE toxic WHEN 1 THEN 'b' WHEN 0 THEN 'a' END AS shown, CASE quality WHEN 1 THEN 'a' WHEN 0 THEN 'b' END AS hidden
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
flips AS (SELECT *, coalesce(shown = orig, false) AS consistent, NOT coalesce(shown = hidden, false) AS flipped FROM rated)"""


def _per_class(rows: str, ref: str, hyp: str) -> str:
    return f"""counts AS (SELECT c AS class, count(*) FILTER ({hyp} = c AND {ref} = c) AS tp, count(*) FILTER ({hyp} = c AND {ref} <> c) AS fp, count(*) FILTER ({hyp} <> c AND {ref} = c) AS fn
  FROM {rows}, (SELECT unnest([0, 1])::INT AS c) GROUP BY 1),
pr AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM counts),
prf AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM pr)"""


_FISHER = """docs AS (SELECT d.doc_id, text, toxic::INT AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
total AS (SELECT count(*) AS everything, sum(y)::BIGINT AS ones FROM docs),
tags AS (SELECT tag, count(*) AS n, sum(y)::BIGINT AS a FROM tagged JOIN docs USING (doc_id) GROUP BY 1 HAVING count(*) >= 5),
cells AS (SELECT tag, n, a, n - a AS b, ones - a AS c, (everything - n) - (ones - a) AS d, everything, ones FROM tags, total),
ks AS (SELECT *, unnest(range(greatest(0, ones - (everything - n)), least(n, ones) + 1)) AS k FROM cells),
ps AS (SELECT *, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(everything - n + 1) - lgamma(ones - k + 1) - lgamma(everything - n - ones + k + 1)
   - lgamma(everything + 1) + lgamma(ones + 1) + lgamma(everything - ones + 1)) AS prob FROM ks),
own AS (SELECT tag, prob AS mine FROM ps WHERE k = a),
tests AS (SELECT tag, any_value(n) AS n, any_value(a) AS a, least(1.0, sum(prob) FILTER (prob <= mine * (1 + 1e-7))) AS p FROM ps JOIN own USING (tag) GROUP BY 1),
ranked AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, tag) AS raw FROM tests),
adjusted AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p, tag ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked)"""


def _uniform(stream: str) -> tuple[str, str]:
    """A number for each of 2,000 resamples, as stats.intervals.uniforms draws them."""
    return "(SELECT unnest(range(2000)) AS b)", f"('0x' || substr(md5('0:{stream}:' || b), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def _draws(name: str, source: str, keys: str, k: str, n: str, stream: str) -> str:
    """A binomial count of each resample for the rows (keys, k of n) of a table: the least whose distribution function
    reaches the resample's number."""
    rows, u = _uniform(stream)
    return f"""{name}_u AS (SELECT b, {u} AS u FROM {rows}),
{name}_k AS (SELECT {keys}, {n} AS m, {k} / {n}::DOUBLE AS p, unnest(range(0, {n} + 1)) AS x FROM {source} WHERE {n} > 0),
{name}_f AS (SELECT {keys}, x, sum(CASE WHEN p <= 0 THEN (x = 0)::INT WHEN p >= 1 THEN (x = m)::INT
   ELSE exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + x * ln(p) + (m - x) * ln(1 - p)) END) OVER (PARTITION BY {keys} ORDER BY x) AS f FROM {name}_k),
{name} AS (SELECT {keys}, b, least(count(*) FILTER (f < u), max(x)) AS x FROM {name}_f, {name}_u GROUP BY ALL)"""


#: I_x(a, b) as a continued fraction of 200 steps, from the end.
_BETA = """(exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a / list_reduce(list_reverse(range(1, 201)), lambda acc, i: 1 +
  (CASE WHEN i % 2 = 1 THEN -(a + i // 2) * (a + b + i // 2) * x / ((a + 2 * (i // 2)) * (a + 2 * (i // 2) + 1)) ELSE (i // 2) * (b - i // 2) * x / ((a + 2 * (i // 2) - 1) * (a + 2 * (i // 2))) END) / acc, 1.0::DOUBLE))"""
_HITS = "hits AS (SELECT tag, count(*) AS n, count(*) FILTER (toxic = 1) AS hits FROM tagged JOIN labels USING (doc_id) GROUP BY 1)"


def _f1(rows: str, ref: str, hyp: str) -> str:
    """Counts per class and the resampled F1."""
    return f"""{_per_class(rows, ref, hyp)}, all_rows AS (SELECT count(*) AS n FROM {rows}),
cells AS (SELECT class, tp, fp, fn, n FROM counts, all_rows), {_draws("r", "cells", "class", "tp", "n", "a")},
rest AS (SELECT DISTINCT r.class, r.x AS tp_x, n - r.x AS left_over, (fp + fn) / greatest(n - tp, 1)::DOUBLE AS p FROM r JOIN cells USING (class)),
wk AS (SELECT *, unnest(range(0, left_over + 1)) AS w FROM rest),
wf AS (SELECT class, tp_x, w, left_over, sum(CASE WHEN p <= 0 THEN (w = 0)::INT WHEN p >= 1 THEN (w = left_over)::INT
   ELSE exp(lgamma(left_over + 1) - lgamma(w + 1) - lgamma(left_over - w + 1) + w * ln(p) + (left_over - w) * ln(1 - p)) END) OVER (PARTITION BY class, tp_x ORDER BY w) AS f FROM wk),
wu AS (SELECT b, {_uniform("b")[1]} AS u FROM {_uniform("b")[0]}),
wx AS (SELECT r.class, r.b, r.x, least(count(*) FILTER (f < u), max(w)) AS w FROM r JOIN wu USING (b) JOIN wf ON wf.class = r.class AND wf.tp_x = r.x GROUP BY ALL),
boot AS (SELECT class, quantile_cont(2 * x / greatest(2 * x + w, 1)::DOUBLE, 0.025) AS low, quantile_cont(2 * x / greatest(2 * x + w, 1)::DOUBLE, 0.975) AS high FROM wx GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    terms = " UNION ALL ".join(
        f"SELECT '{n}' AS term, count(*) FILTER (raw) AS raw, count(*) FILTER (raw AND hit) AS boundary, count(*) FILTER (raw AND hit AND ctx) AS strict FROM "
        f"(SELECT contains(lower(text), '{n.split()[0]}') OR contains(lower(text), '{n}') AS raw, regexp_matches(text, '{_word(p)}', 'i') AS hit, "
        f"regexp_matches(text, '{_word(CONTEXT_SQL)}', 'i') AS ctx FROM documents)"
        for n, p in TERMS.items()
    )
    sql = {
        "link_summary": f"""WITH {_PAPERS}, {_EDGES}, wanted AS (SELECT * FROM papers WHERE year <= 1998),
          f AS (SELECT e.*, reftype = 'A' AS app, confscore >= 5 AS conf FROM edges e SEMI JOIN wanted USING (oaid)), j AS (SELECT f.* FROM f LEFT JOIN wanted USING (oaid))
          SELECT count(*) AS n_links, count(DISTINCT patent) AS n_patents, count(DISTINCT oaid) AS n_works, (SELECT count(*) FROM f) AS n_edges,
          count(DISTINCT patent) FILTER (app) AS n_patents_app, count(DISTINCT patent) FILTER (NOT app) AS n_patents_other, count(DISTINCT patent) FILTER (conf) AS n_patents_confident,
          count(DISTINCT patent) FILTER (app AND conf) AS n_patents_app_confident FROM j""",
        "link_reftype_freq": f"WITH {_EDGES} SELECT reftype, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM edges GROUP BY 1",
        "link_wherefound_freq": f"WITH {_EDGES} SELECT wherefound, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM edges WHERE wherefound IN ('O', 'F') GROUP BY 1",
        "uncited_papers": f"WITH {_PAPERS}, {_EDGES} SELECT DISTINCT oaid FROM papers ANTI JOIN edges USING (oaid)",
        "venue_top": f"WITH {_PAPERS} SELECT venue, count(*) AS n FROM papers GROUP BY 1 ORDER BY n DESC, venue LIMIT 3",
        "supplier_top": f"WITH {_EDGES} SELECT arm_key, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, arm_key LIMIT 20",
        "cited_year_buckets": f"""WITH {_PAPERS}, {_EDGES}, p AS (SELECT {_BUCKET} AS bucket, oaid IN (SELECT oaid FROM edges) AS cited FROM papers)
          SELECT bucket, count(*) AS n, count(*) FILTER (cited) AS hits, round(count(*) FILTER (cited) / count(*), 6) AS share FROM p WHERE bucket IS NOT NULL GROUP BY 1""",
        "venue_year_rates": f"""WITH {_PAPERS}, {_EDGES}, p AS (SELECT venue, {_BUCKET} AS bucket, oaid IN (SELECT oaid FROM edges WHERE confscore >= 45) AS cited FROM papers),
          c AS (SELECT venue, bucket, count(*) AS n, count(*) FILTER (cited) AS hits FROM p WHERE bucket IS NOT NULL GROUP BY 1, 2),
          g AS (SELECT * FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE']) AS venue), (SELECT unnest([{", ".join(f"'{a}-{b}'" for a, b in BUCKETS)}]) AS bucket))
          SELECT venue, bucket, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, round(CASE WHEN n > 0 THEN hits / n END, 6) AS rate FROM g LEFT JOIN c USING (venue, bucket)""",
        "paper_range": f"WITH {_PAPERS} SELECT min(year) AS first, max(year) AS last, count(*) AS n FROM papers",
        "tag_counts": f"WITH {_TAGS} SELECT tag, count(*) AS n FROM tagged GROUP BY 1",
        "tag_rates": f"WITH {_TAGS} SELECT tag, count(*) AS n, count(*) FILTER (toxic = 1) AS hits, round(count(*) FILTER (toxic = 1) / count(*), 6) AS rate FROM tagged JOIN labels USING (doc_id) GROUP BY 1",
        "tag_reach": f"WITH {_TAGS} SELECT tag, count(DISTINCT source || '/' || lang) AS reached FROM tagged GROUP BY 1",
        "tag_jeffreys": f"""WITH RECURSIVE {_TAGS}, {_HITS}, base AS (SELECT sum(toxic) / count(*) AS base FROM labels),
          bis(tag, n, hits, side, i, lo, hi) AS (SELECT tag, n, hits, unnest([0.025, 0.975])::DOUBLE, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM hits
          UNION ALL SELECT tag, n, hits, side, i + 1, CASE WHEN f < side THEN mid ELSE lo END, CASE WHEN f < side THEN hi ELSE mid END FROM (SELECT *, CASE WHEN turned THEN 1 - {_BETA} ELSE {_BETA} END AS f FROM
            (SELECT *, (lo + hi) / 2 AS mid, mid > (hits + 1.5) / (n + 3) AS turned, CASE WHEN turned THEN n - hits + 0.5 ELSE hits + 0.5 END::DOUBLE AS a, CASE WHEN turned THEN hits + 0.5 ELSE n - hits + 0.5 END::DOUBLE AS b,
             CASE WHEN turned THEN 1 - mid ELSE mid END AS x FROM bis WHERE i < 50))),
          q AS (SELECT tag, n, hits, max((lo + hi) / 2) FILTER (side < 0.5) AS low, max((lo + hi) / 2) FILTER (side > 0.5) AS high FROM bis WHERE i = 50 GROUP BY ALL),
          e AS (SELECT tag, n, hits, CASE WHEN hits = 0 THEN 0 ELSE low END AS low, CASE WHEN hits = n THEN 1 ELSE high END AS high FROM q)
          SELECT tag, n, hits, round(low, 6) AS low, round(high, 6) AS high, low > base OR high < base AS excludes_base FROM e, base""",
        "bootstrap_ci": f"""WITH {_TAGS}, {_HITS}, {_draws("r", "hits", "tag, n, hits", "hits", "n", "a")}
          SELECT tag, n, hits, round(quantile_cont(x / n::DOUBLE, 0.025), 6) AS low, round(quantile_cont(x / n::DOUBLE, 0.975), 6) AS high FROM r GROUP BY ALL""",
        "bootstrap_ratio": f"""WITH c AS (SELECT count(*) FILTER (lang = 'en' AND toxic = 1) AS k1, count(*) FILTER (lang = 'en') AS n1, count(*) FILTER (lang <> 'en' AND toxic = 1) AS k0,
          count(*) FILTER (lang <> 'en') AS n0 FROM documents JOIN labels USING (doc_id)), {_draws("one", "c", "n1", "k1", "n1", "a")}, {_draws("zero", "c", "n0", "k0", "n0", "b")},
          q AS (SELECT (one.x / n1::DOUBLE) / (zero.x / n0::DOUBLE) AS q FROM one JOIN zero USING (b) WHERE zero.x > 0)
          SELECT round(avg(q), 6) AS ratio, round(quantile_cont(q, 0.025), 6) AS low, round(quantile_cont(q, 0.975), 6) AS high FROM q""",
        "rare_tag_fisher_bh": f"WITH {_TAGS}, {_FISHER} SELECT tag, n, a, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS significant FROM adjusted",
        "era_case": f"WITH {_ERA} SELECT p_partkey, pid, era, coalesce(try_cast(nullif(regexp_extract(raw, '([0-9]{{6,}})', 1), '') AS BIGINT), -1) AS number FROM eras",
        "record_types": f"WITH {_ERA} SELECT CASE WHEN era IN ('application', 'design/other') THEN era ELSE 'granted utility' END AS kind, count(*) AS n FROM eras GROUP BY 1",
        "control_sample": f"""WITH {_EDGES} SELECT patent FROM (SELECT DISTINCT patent FROM edges WHERE patent NOT IN (SELECT patent FROM edges WHERE confscore >= 49))
          ORDER BY md5('42:' || patent), patent LIMIT 250""",
        "seed_sample": f"WITH {_EDGES} SELECT patent FROM (SELECT DISTINCT patent FROM edges) ORDER BY md5('42:' || patent), patent LIMIT 300",
        "random_rows": f"""WITH {_EDGES}, r AS (SELECT oaid || '-' || ord AS row, patent, p_name FROM edges JOIN part ON patent = p_partkey) SELECT row, patent, p_name FROM r ORDER BY md5('7:' || row), row LIMIT 50""",
        "coder_sheets": "SELECT item_id, row_number() OVER (ORDER BY md5('5:a:' || item_id), item_id)::INT AS item_a, row_number() OVER (ORDER BY md5('5:b:' || item_id), item_id)::INT AS item_b FROM benchmark",
        "work_queue": "SELECT s_suppkey, md5('9:' || s_suppkey) AS key FROM supplier",
        "strata_sheet": f"WITH {_STRATA} SELECT doc_id, label, stratum FROM sample",
        "strata_weights": f"WITH {_STRATA}, {_WEIGHTS} SELECT stratum, population, sample, round(weight, 6) AS weight FROM weights",
        "reweighted_share": f"""WITH {_STRATA}, {_WEIGHTS} SELECT quality, round(sum(weight * n) / greatest((SELECT sum(population) FROM weights), 1), 6) AS share
          FROM (SELECT stratum, quality, count(*) AS n FROM sample WHERE quality <> toxic GROUP BY 1, 2) JOIN weights USING (stratum) GROUP BY 1""",
        "arm_compare": f"WITH {_ARMS} SELECT era, k1, n1, k0, n0, round(CASE WHEN n1 > 0 THEN k1 / n1 END, 6) AS rate1, round(CASE WHEN n0 > 0 THEN k0 / n0 END, 6) AS rate0 FROM cells",
        "arm_standardised": f"""WITH {_ARMS} SELECT round(sum(n1 * (k0 / n0)) / sum(n1), 6) AS standardised, round(sum(k1) / sum(n1), 6) AS rate1, round(sum(k0) / sum(n0), 6) AS crude0 FROM cells WHERE n0 > 0""",
        "arm_mh": f"""WITH {_ARMS}, x AS (SELECT k1 + 0.5 AS a, n1 - k1 + 0.5 AS b, k0 + 0.5 AS c, n0 - k0 + 0.5 AS d FROM cells WHERE n1 > 0 AND n0 > 0),
          y AS (SELECT a * d / (a + b + c + d) AS r, b * c / (a + b + c + d) AS s, (a + d) / (a + b + c + d) AS p, (b + c) / (a + b + c + d) AS q FROM x),
          z AS (SELECT sum(r)::DOUBLE AS r, sum(s)::DOUBLE AS s, sum(p * r)::DOUBLE AS pr, sum(p * s + q * r)::DOUBLE AS pq, sum(q * s)::DOUBLE AS qs, count(*) AS strata FROM y),
          e AS (SELECT *, 1.959963984540054 * sqrt(pr / (2 * r * r) + pq / (2 * r * s) + qs / (2 * s * s)) AS w FROM z)
          SELECT round(r / s, 6) AS odds_ratio, round(exp(ln(r / s) - w), 6) AS low, round(exp(ln(r / s) + w), 6) AS high, strata FROM e""",
        "arm_mh_p": f"""WITH {_ARMS}, x AS (SELECT k1 + 0.5 AS a, n1 - k1 + 0.5 AS b, k0 + 0.5 AS c, n0 - k0 + 0.5 AS d, a + b + c + d AS n FROM cells WHERE n1 > 0 AND n0 > 0),
          y AS (SELECT sum(a - (a + b) * (a + c) / n)::DOUBLE AS over, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)))::DOUBLE AS variance FROM x),
          z AS (SELECT sqrt(over * over / variance / 2) AS z FROM y)
          SELECT round(1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(z) + i * ln(2) - (lgamma(2 * i + 2) - lgamma(i + 1) - i * ln(2))))), 6) AS p FROM z""",
        "arm_single": f"WITH {_EDGES} SELECT oaid, min(arm_key) AS arm_key FROM edges GROUP BY 1",
        "arm_membership": f"WITH {_EDGES} SELECT arm_key, count(DISTINCT oaid) AS n_works FROM edges GROUP BY 1",
        "arm_reach": f"""WITH {_EDGES}, f AS (SELECT arm_key, oaid, bool_or(confscore >= 40) AS c FROM edges GROUP BY 1, 2) SELECT arm_key, count(*) AS n_works, round(count(*) FILTER (c) / count(*), 6) AS share FROM f GROUP BY 1""",
        "upsert_first_last": f"WITH {_EDGES} SELECT oaid, arg_min(arm_key, ord * 100000000 + arm_key) AS first_arm, arg_max(arm_key, ord * 100000000 + arm_key) AS last_arm FROM edges GROUP BY 1",
        "kappa_ac1": """WITH x AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS raw, avg((quality = 0)::INT) AS a0, avg((quality = 1)::INT) AS a1, avg((toxic = 0)::INT) AS b0, avg((toxic = 1)::INT) AS b1 FROM labels),
          y AS (SELECT n, raw, a0 * b0 + a1 * b1 AS e, (a0 + b0) / 2 * (1 - (a0 + b0) / 2) + (a1 + b1) / 2 * (1 - (a1 + b1) / 2) AS g FROM x)
          SELECT n, round(raw, 6) AS raw, round(CASE WHEN e < 1 THEN (raw - e) / (1 - e) ELSE 1 END, 6) AS kappa, round(CASE WHEN g < 1 THEN (raw - g) / (1 - g) ELSE 1 END, 6) AS ac1 FROM y""",
        "confusion_prf": f"WITH {_per_class('labels', 'quality', 'toxic')} SELECT class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf",
        "f1_interval": f"""WITH {_f1("labels", "quality", "toxic")} SELECT class, round(f1, 6) AS f1, round(low, 6) AS low, round(high, 6) AS high, f1 >= 0.60 AS gate FROM prf JOIN boot USING (class)""",
        "consensus_rates": f"""WITH r0 AS (SELECT quality, (length(text) > 2000)::INT AS long FROM documents JOIN labels USING (doc_id) WHERE quality = toxic), {_f1("r0", "quality", "long")}
          SELECT class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(low, 6) AS low, round(high, 6) AS high, f1 >= 0.60 AS gate FROM prf JOIN boot USING (class)""",
        "consensus_agreement": """WITH r AS (SELECT quality AS q, (length(text) > 2000)::INT AS t FROM documents JOIN labels USING (doc_id) WHERE quality = toxic),
          x AS (SELECT count(*) AS n, avg((q = t)::INT) AS raw, avg((q = 0)::INT) AS a0, avg((q = 1)::INT) AS a1, avg((t = 0)::INT) AS b0, avg((t = 1)::INT) AS b1 FROM r),
          y AS (SELECT n, raw, a0 * b0 + a1 * b1 AS e, (a0 + b0) / 2 * (1 - (a0 + b0) / 2) + (a1 + b1) / 2 * (1 - (a1 + b1) / 2) AS g FROM x)
          SELECT n, round(raw, 6) AS raw, round(CASE WHEN e < 1 THEN (raw - e) / (1 - e) ELSE 1 END, 6) AS kappa, round(CASE WHEN g < 1 THEN (raw - g) / (1 - g) ELSE 1 END, 6) AS ac1 FROM y""",
        "rate_ranking": f"""WITH {_TAGS}, {_HITS}, r AS (SELECT tag, CASE WHEN n >= 20 THEN hits / n END AS rate FROM hits)
          SELECT row_number() OVER (ORDER BY rate DESC NULLS LAST, tag)::INT AS place, tag, coalesce(round(rate, 6), -1) AS rate FROM r""",
        "distinct_lists": "SELECT c_mktsegment AS segment, string_agg(c_nationkey::VARCHAR, ',' ORDER BY c_nationkey) AS nations FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) GROUP BY 1",
        "link_fanout": f"""WITH {_PAPERS}, {_EDGES}, wanted AS (SELECT * FROM papers WHERE year <= 1998), two AS (SELECT * FROM wanted UNION ALL SELECT * FROM wanted WHERE oaid % 5 = 0),
          f AS (SELECT * FROM edges SEMI JOIN two USING (oaid)), j AS (SELECT f.* FROM f LEFT JOIN two USING (oaid))
          SELECT count(*) AS n_links, (SELECT count(*) FROM f) AS n_edges, count(DISTINCT oaid) AS n_works, count(DISTINCT patent) AS n_patents FROM j""",
        "spend_cap": """WITH k AS (SELECT DISTINCT md5('model|' || text) AS key, length(text) / 1000 AS cost FROM documents),
          c AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM k)
          SELECT key, round(cost, 6) AS cost, round(spent, 6) AS spent FROM c WHERE spent <= 100""",
        "html_unescape": r"""WITH x AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS h FROM pages)
          SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')))::INT AS n FROM x""",
        "flip_rates": f"""WITH {_FLIPS}, m AS (SELECT flipped, unnest(['all', 'shown_b', 'english']) AS mask, unnest([true, coalesce(shown = 'b', false), coalesce(lang = 'en', false)]) AS inside FROM flips)
          SELECT mask, count(*) AS n, count(*) FILTER (flipped) AS flips, round(count(*) FILTER (flipped) / count(*), 6) AS rate FROM m WHERE inside GROUP BY 1""",
        "flip_consistency": f"WITH {_FLIPS} SELECT consistent, flipped, count(*) AS n FROM flips GROUP BY 1, 2",
        "stacked_arms": "SELECT 'orders' AS arm, count(*) AS n, sum(o_custkey)::BIGINT AS sum_key FROM orders UNION ALL SELECT 'customers', count(*), sum(c_custkey)::BIGINT FROM customer",
        "crosstab_label_class": """SELECT toxic, count(*) FILTER (NOT coalesce(source IN ('src0', 'src1', 'src2'), false)) AS other, count(*) FILTER (coalesce(source IN ('src0', 'src1', 'src2'), false)) AS in_class
          FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
        "class_codes": "SELECT p_size % 5 IN (0, 1) AS surveillance, count(*) AS n FROM part GROUP BY 1",
        "assignees": "SELECT s_suppkey % 4 IN (0, 1) AS defence, count(*) AS n FROM supplier GROUP BY 1",
        "missing_by_year": """WITH r AS (SELECT (2015 + doc_id % 10)::INT AS year, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 400 AS u FROM documents),
          g AS (SELECT year, count(*) FILTER (NOT u) AS missing, count(*) AS total FROM r GROUP BY 1) SELECT year, missing, total, round(missing / total, 6) AS share, total > 50 AND missing / total > 0.5 AS is_gap FROM g""",
        "missing_by_branch": """WITH g AS (SELECT coalesce(nullif(source, ''), '(none)') AS branch, count(*) FILTER (NOT length(text) >= 800) AS missing, count(*) AS total FROM documents GROUP BY 1)
          SELECT branch, missing, total, round(missing / total, 6) AS share FROM g WHERE total >= 20 ORDER BY missing / total DESC, branch LIMIT 12""",
        "kth_mention": """WITH r AS (SELECT event_type, user_id % 2 AS arm, dayofyear(ts)::INT AS day, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY dayofyear(ts), event_id) AS k FROM events)
          SELECT event_type, arm, count(*) AS n, coalesce(max(day) FILTER (k = 1), -1) AS k1, coalesce(max(day) FILTER (k = 5), -1) AS k5, coalesce(max(day) FILTER (k = 25), -1) AS k25, coalesce(max(day) FILTER (k = 100), -1) AS k100 FROM r GROUP BY 1, 2""",
        "award_arms": f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a power transformer with voltage ' ELSE 'a transformer for neural text ' END || text AS abstract FROM documents)
          SELECT CASE WHEN doc_id % 5 IN (0, 2) THEN 'defence' ELSE 'civilian' END AS arm, count(*) AS n FROM a WHERE doc_id % 5 <> 4
          AND NOT (regexp_matches(abstract, '{ELECTRICAL}', 'i') AND NOT regexp_matches(abstract, '{AI_CONTEXT_SHORT}', 'i')) GROUP BY 1""",
        "term_three_level": terms,
        "term_snippets": r"""WITH h AS (SELECT doc_id, text, regexp_extract(text, 'licen[cs]e', 0, 'i') AS m FROM documents WHERE regexp_matches(text, 'licen[cs]e', 'i')),
          p AS (SELECT doc_id, text, m, instr(text, m) AS pos FROM h), q AS (SELECT doc_id, text, m, pos, greatest(pos - 30, 1) AS b FROM p)
          SELECT doc_id, trim(regexp_replace(substring(text, b, pos - b + length(m) + 30), '\s+', ' ', 'g')) AS snippet, 'license' AS term, row_number() OVER (ORDER BY doc_id)::INT AS item FROM q QUALIFY item <= 2""",
        "dedup_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
        "last_turn": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1",
        "doi_norm_join": """WITH w AS (SELECT '10.1/' || (page_id % 30) AS doi_norm, min(page_id) AS work FROM pages GROUP BY 1)
          SELECT page_id, '10.1/' || (page_id % 40) AS doi_norm, coalesce(work, -1) AS work FROM pages LEFT JOIN w ON w.doi_norm = '10.1/' || (page_id % 40)""",
        "work_ids": "SELECT o_orderkey, o_orderkey::VARCHAR AS id FROM orders",
        "paper_ids": """WITH v AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'acl' ELSE 'P19' END AS venue FROM orders)
          SELECT o_orderkey, venue, venue = 'acl' AS core, venue || '-1.' || o_orderkey AS id, 'Ada ' || o_orderstatus || '; Noor' AS authors, 2 AS n_authors FROM v""",
        "year_parse": """WITH y AS (SELECT o_orderkey % 4 AS k, year(o_orderdate)::INT AS y FROM orders) SELECT CASE WHEN k < 2 THEN y ELSE -1 END AS year, CASE WHEN k <> 1 THEN y ELSE -1 END AS paper_year, count(*) AS n FROM y GROUP BY 1, 2""",
        "label_clean": "SELECT lower(event_type) AS label, count(*) AS n FROM events GROUP BY 1",
        "html_fields": r"""WITH x AS (SELECT page_id, nullif(regexp_extract(html, '(?si)<title[^>]*>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '(?si)<h1[^>]*>(.*?)</h1>', 1), '') AS h1 FROM pages)
          SELECT page_id, title, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(h1, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')), '') AS h1 FROM x""",
        "json_extract": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'neither' END AS label, CASE WHEN event_id % 3 <> 0 THEN (event_id % 3)::INT ELSE -1 END AS confidence FROM events",
        "md5_cache_miss": "WITH k AS (SELECT doc_id, md5('model|' || text) AS key FROM documents) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)",
        "rule_labels": """SELECT CASE WHEN regexp_matches(text || source, 'licen[cs]e', 'i') THEN 'surveillance' WHEN contains(text, '!!') THEN 'dual_use_ambiguous' ELSE 'neither' END AS label, count(*) AS n FROM documents GROUP BY 1""",
        "prompts": """WITH r AS (SELECT p_partkey, p_name AS t, CASE WHEN p_size > 25 THEN p_brand ELSE '(none)' END AS s, CASE WHEN p_size % 2 = 0 THEN '(none)' ELSE p_type END AS a FROM part),
          f AS (SELECT p_partkey, 'Title: ' || t || chr(10) || 'Assignee: ' AS one, s, chr(10) || 'Abstract: ' || a || chr(10) || 'Answer with one JSON object: label, confidence, rationale, insufficient_info.' AS two FROM r)
          SELECT p_partkey, md5(one || s || two) AS shown, md5(one || '(redacted)' || two) AS hidden FROM f""",
        "representativeness": f"""WITH {_EDGES}, p AS (SELECT DISTINCT patent FROM edges), s AS (SELECT patent FROM p ORDER BY md5('3:' || patent), patent LIMIT 200),
          u AS (SELECT 'population' AS set, patent FROM p UNION ALL SELECT 'sample', patent FROM s) SELECT set, count(*) AS n, count(*) FILTER (patent < 1000) AS early, round(count(*) FILTER (patent < 1000) / count(*), 6) AS share FROM u GROUP BY 1""",
        "id_set_sizes": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_nationkey < 12)
          SELECT count(a.k) AS n_a, count(b.k) AS n_b, count(*) FILTER (a.k = b.k) AS n_both, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM a FULL JOIN b ON a.k = b.k""",
        "labelled_coverage": """SELECT count(DISTINCT d.doc_id) AS n, count(DISTINCT l.doc_id) AS labelled, round(count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id), 6) AS coverage
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic IS NOT NULL""",
        "lookup_default": "SELECT coalesce(n_name, '') AS nation, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey GROUP BY 1",
        "chained_membership": f"""WITH {_PAPERS}, {_EDGES}, w AS (SELECT DISTINCT oaid FROM edges WHERE patent IN (SELECT p_partkey FROM part WHERE p_size <= 3))
          SELECT year, count(*) AS n, count(w.oaid) AS cited FROM papers LEFT JOIN w USING (oaid) GROUP BY 1""",
        "triple_coded": """SELECT lang, quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1) AND toxic IN (0, 1) GROUP BY 1, 2, 3""",
        "stream_links": "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1",
        "absent_count": "SELECT count(*) AS n, count(*) FILTER (p_size < 5) AS absent FROM part",
        "digit_years": "SELECT (doc_id % 5 + 2015)::INT AS year, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND length(text) >= 50 GROUP BY 1",
        "omnibus_chi_square": """WITH r AS (SELECT lang, toxic FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, toxic, count(*) AS n FROM r GROUP BY 1, 2),
          e AS (SELECT a.lang, b.toxic, a.n * b.n / t.n AS e FROM (SELECT lang, count(*) AS n FROM r GROUP BY 1) a, (SELECT toxic, count(*) AS n FROM r GROUP BY 1) b, (SELECT count(*) AS n FROM r) t)
          SELECT round(sum((coalesce(n, 0) - e) ** 2 / e), 6) AS statistic, (count(DISTINCT lang) - 1) * (count(DISTINCT toxic) - 1) AS df, (SELECT count(*) FROM r) AS n FROM e LEFT JOIN c USING (lang, toxic)""",
        "in_text_links": "SELECT l_returnflag AS reftype, count(*) FILTER (l_linestatus IN ('O', 'both')) AS in_text, count(*) AS n FROM lineitem GROUP BY 1",
    }
    return sql


CONTEXT_SQL = r"\b(with|for|by)\b"
