"""Registered queries over the sample panels, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.functions.columns import round_half_up
from tessella.functions.tables import written
from tessella.operators import classify, metrics, panel, quality, trend

from . import sample_panel as S
from .sample_panel import SQL, r

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {SQL} {sql.strip()}"
        return f

    return add


def _both(spark, sf_dir):
    return S.coarse_panel(spark, sf_dir), S.coarse_region(spark, sf_dir), S.coarse_indicator(spark, sf_dir)


def _fine(spark, sf_dir):
    return S.fine_panel(spark, sf_dir), S.fine_region(spark, sf_dir), S.fine_indicator(spark, sf_dir)


def _weights(p: DataFrame, weight: str = "orders") -> DataFrame:
    return p.where(F.col("indicator") == weight).select("geo", F.lit(weight).alias("weight"), "year", "region_id", F.col("value").alias("w"))


W_ORDERS = "weights AS (SELECT geo, 'orders' AS weight, year, region_id, value AS w FROM panel WHERE indicator = 'orders')"
W_QTY = "weights AS (SELECT geo, 'qty' AS weight, year, region_id, value AS w FROM fine WHERE indicator = 'qty')"


@register("panel_union", "SELECT * FROM panel UNION ALL SELECT * FROM fine")
def panel_union(spark, sf_dir):
    return panel.union_panels(S.coarse_panel(spark, sf_dir), S.fine_panel(spark, sf_dir))


@register(
    "remap_regions",
    f"""SELECT r_name AS geo, CAST(n_nationkey AS VARCHAR) AS region_id, year, {r("avg_value", 1)} AS value FROM (
  SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS avg_value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 3""",
)
def remap_regions(spark, sf_dir):
    orders, customer = S.read(spark, sf_dir, "orders"), S.read(spark, sf_dir, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").cast("string").alias("src_code"), F.year("o_orderdate").alias("year"))
    rows = rows.agg((F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double") / F.count("*")).alias("value"))
    crosswalk = S.coarse_region(spark, sf_dir).where("cast(region_id as int) % 5 <> 3").select("geo", F.col("region_id").alias("src_code"), "region_id")
    return panel.remap_regions(rows, crosswalk, 1).select("geo", "region_id", "year", "value")


@register("keep_regions", "SELECT * FROM fine WHERE region_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 25)")
def keep_regions(spark, sf_dir):
    wanted = S.read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("region_id"))
    return panel.keep_regions(S.fine_panel(spark, sf_dir), wanted, "region_id").select("geo", "indicator", "year", "region_id", "value")


@register(
    "drop_totals",
    "SELECT * FROM fine WHERE region_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10)",
)
def drop_totals(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir)
    totals = p.groupBy("geo", "indicator", "year").agg(F.sum("value").alias("value")).withColumn("region_id", F.lit("TOTAL"))
    wanted = S.read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("region_id"))
    return panel.drop_totals(p.unionByName(totals), wanted, "region_id").select("geo", "indicator", "year", "region_id", "value")


@register("unlabelled_ids", "SELECT DISTINCT geo, region_id FROM fine WHERE CAST(region_id AS BIGINT) NOT IN (SELECT p_partkey FROM part WHERE p_name LIKE '%a%')")
def unlabelled_ids(spark, sf_dir):
    return panel.unlabelled_ids(S.fine_panel(spark, sf_dir), S.fine_region(spark, sf_dir).where("label like '%a%'"))


@register("positive_weights", "SELECT geo, indicator, year, region_id, value - 0.05 AS value FROM fine WHERE indicator = 'avg_discount' AND value - 0.05 > 0")
def positive_weights(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir).where("indicator = 'avg_discount'").withColumn("value", F.col("value") - 0.05)
    return panel.positive_weights(p)


@register(
    "finite_values",
    "SELECT event_type, count(*) AS n, count(*) FILTER (value IS NOT NULL AND isfinite(value)) AS n_finite, count(*) FILTER (value > 20 AND value <= 50) AS n_mid FROM events GROUP BY 1",
)
def finite_values(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    v = F.col("value")
    odd = F.when(v <= 20, F.lit(float("nan"))).when(v > 50, F.lit(float("inf"))).otherwise(v)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(C.finite("value")).alias("n_finite"), F.count_if(C.finite(odd)).alias("n_mid"))


@register("round_half_up", f"SELECT o_orderkey, {r('(o_totalprice - 150000) / 1000', 0)} AS thousands, {r('(o_totalprice - 150000) / 8', 1)} AS eighths FROM orders")
def round_half_up_query(spark, sf_dir):
    v = F.col("o_totalprice") - 150000
    return S.read(spark, sf_dir, "orders").select("o_orderkey", round_half_up(v / 1000, 0).alias("thousands"), round_half_up(v / 8, 1).alias("eighths"))


@register("year_label", "SELECT l_shipmode_code AS code, count(*) AS n, CASE WHEN l_shipmode_code = '1996' THEN 'leap year' ELSE l_shipmode_code END AS label FROM (SELECT CAST(year(l_shipdate) AS VARCHAR) AS l_shipmode_code FROM lineitem) GROUP BY 1")
def year_label(spark, sf_dir):
    years = S.read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("string").alias("code")).agg(F.count("*").alias("n"))
    return years.withColumn("label", C.year_label("code", F.create_map(F.lit("1996"), F.lit("leap year"))))


@register("numeric_years", "SELECT geo, indicator, year, region_id, value FROM fine WHERE indicator = 'qty'")
def numeric_years(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir)
    label = F.when(F.col("indicator") == "qty", F.col("year").cast("string")).otherwise(F.concat(F.lit("y"), F.col("year")))
    return panel.numeric_years(p.withColumn("year", label)).select("geo", "indicator", "year", "region_id", "value")


@register("min_points", "SELECT * FROM fine WHERE (geo, indicator, region_id) IN (SELECT (geo, indicator, region_id) FROM fine GROUP BY ALL HAVING count(*) >= 7)")
def min_points(spark, sf_dir):
    return panel.min_points(S.fine_panel(spark, sf_dir), 7).select("geo", "indicator", "year", "region_id", "value")


@register(
    "prune_sparse_years",
    """SELECT f.* FROM fine f JOIN (SELECT geo, indicator, year FROM fine JOIN fine_n USING (geo) WHERE value > 60 OR indicator = 'qty' GROUP BY geo, indicator, year, n_regions
  HAVING count(*) FILTER (value > 60) >= ceil(n_regions * 0.8)) USING (geo, indicator, year) WHERE f.value > 60""",
)
def prune_sparse_years(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir).where("value > 60")
    return panel.prune_sparse_years(p, panel.region_counts(S.fine_region(spark, sf_dir)), 0.8).select("geo", "indicator", "year", "region_id", "value")


@register(
    "summarise",
    """, per AS (SELECT geo, indicator, year, count(*) AS have FROM fine WHERE indicator = 'qty' GROUP BY ALL)
SELECT i.geo, i.indicator, i.kind, min(year) AS first_year, max(year) AS last_year, CASE WHEN count(year) > 0 THEN count(year) END AS n_years, arg_max(have, year) AS latest_regions,
       CASE WHEN count(year) = 0 THEN 'EMPTY' ELSE 'ok' END AS status
FROM fine_indicator i LEFT JOIN per USING (geo, indicator) GROUP BY i.geo, i.indicator, i.kind""",
)
def summarise(spark, sf_dir):
    p, _, i = _fine(spark, sf_dir)
    return panel.summarise(p.where("indicator = 'qty'"), i)


@register("weight_candidates", "SELECT geo, indicator, kind FROM indicator_dim WHERE kind = 'count' AND geo <> 'ASIA' UNION ALL SELECT geo, indicator, kind FROM indicator_dim WHERE geo = 'ASIA' AND kind <> 'count'")
def weight_candidates(spark, sf_dir):
    i = S.coarse_indicator(spark, sf_dir).where("geo <> 'ASIA' or kind <> 'count'")
    return panel.weight_candidates(i).select("geo", "indicator", "kind")


PAIRS = "pairs AS (SELECT a.geo, a.indicator, b.indicator AS weight FROM fine_indicator a JOIN fine_indicator b ON a.geo = b.geo AND b.kind = 'count')"


def _pairs(i: DataFrame) -> DataFrame:
    return i.select("geo", "indicator").join(i.where("kind = 'count'").select("geo", F.col("indicator").alias("weight")), "geo")


@register(
    "shared_years",
    f""", {PAIRS}, p AS (SELECT DISTINCT geo, indicator, year FROM fine WHERE indicator <> 'qty' OR (year > 1996 AND geo <> 'Brand#11')),
b AS (SELECT q.geo, q.indicator, q.weight, p.year, w.year IS NOT NULL AS hit FROM pairs q JOIN p USING (geo, indicator) LEFT JOIN p w ON w.geo = q.geo AND w.indicator = q.weight AND w.year = p.year),
c AS (SELECT *, bool_or(hit) OVER (PARTITION BY geo, indicator, weight) AS any_hit FROM b), d AS (SELECT * FROM c WHERE hit OR NOT any_hit)
SELECT geo, indicator, weight, year, year = max(year) OVER (PARTITION BY geo, indicator, weight) AS is_default FROM d""",
)
def shared_years(spark, sf_dir):
    p, _, i = _fine(spark, sf_dir)
    return metrics.shared_years(p.where("indicator <> 'qty' or (year > 1996 and geo <> 'Brand#11')"), _pairs(i))


@register(
    "weight_slice",
    """, p AS (SELECT * FROM fine WHERE indicator = 'qty' AND year < 1999), y AS (SELECT DISTINCT geo, year FROM fine), h AS (SELECT DISTINCT geo, year FROM p), l AS (SELECT geo, max(year) AS last FROM h GROUP BY geo),
c AS (SELECT y.geo, y.year, coalesce(h.year, l.last) AS weight_year FROM y LEFT JOIN h USING (geo, year) JOIN l USING (geo))
SELECT c.geo, 'qty' AS weight, c.year, c.weight_year, p.region_id, p.value AS w FROM c JOIN p ON p.geo = c.geo AND p.year = c.weight_year""",
)
def weight_slice(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir)
    wanted = p.select("geo", F.lit("qty").alias("weight"), "year")
    return metrics.weight_slice(p.where("indicator = 'qty' and year < 1999"), wanted).select("geo", "weight", "year", "weight_year", "region_id", "w")


HEADLINE = f"""SELECT p.geo, p.indicator, p.year, {r("CASE WHEN i.kind = 'count' THEN sum(p.value) WHEN sum(coalesce(w, 1)) FILTER (p.value IS NOT NULL) > 0 THEN sum(p.value * coalesce(w, 1)) / sum(coalesce(w, 1)) FILTER (p.value IS NOT NULL) END", 4)} AS value,
  CASE WHEN count(p.value) = 0 THEN 'no data' WHEN i.kind = 'count' THEN 'Total' WHEN count(w) FILTER (p.value IS NOT NULL) > 0 THEN 'weighted mean' ELSE 'mean' END AS label
FROM {{panel}} p JOIN {{indicator}} i USING (geo, indicator) LEFT JOIN weights w ON w.geo = p.geo AND w.year = p.year AND w.region_id = p.region_id AND {{use}} GROUP BY p.geo, p.indicator, p.year, i.kind"""


@register("headline", f", {W_ORDERS} " + HEADLINE.format(panel="panel", indicator="indicator_dim", use="w.w % 3 <> 0"))
def headline(spark, sf_dir):
    p, _, i = _both(spark, sf_dir)
    return metrics.headline(p, _weights(p).where("w % 3 <> 0"), i).withColumn("value", round_half_up("value", 4))


# a third of the years without values
GAPS = "(SELECT geo, indicator, year, region_id, CASE WHEN year % 3 <> 0 THEN value END AS value FROM fine)"


@register("headline_gaps", f", {W_QTY} " + HEADLINE.format(panel=GAPS, indicator="fine_indicator", use="w.w % 2 = 0"))
def headline_gaps(spark, sf_dir):
    """Slices that hold no value have a row that says so."""
    p, _, i = _fine(spark, sf_dir)
    gaps = p.withColumn("value", F.when(F.col("year") % 3 != 0, F.col("value")))
    return metrics.headline(gaps, _weights(p, "qty").where("w % 2 = 0"), i).withColumn("value", round_half_up("value", 4))


@register("headline_fine", f", {W_QTY} " + HEADLINE.format(panel="fine", indicator="fine_indicator", use="w.w % 2 = 0"))
def headline_fine(spark, sf_dir):
    p, _, i = _fine(spark, sf_dir)
    return metrics.headline(p, _weights(p, "qty").where("w % 2 = 0"), i).withColumn("value", round_half_up("value", 4))


@register("coverage", f"SELECT geo, indicator, year, count(*) FILTER (value > 0) AS have, n_regions, {r('count(*) FILTER (value > 0) / n_regions', 6)} AS share FROM fine JOIN fine_n USING (geo) GROUP BY geo, indicator, year, n_regions")
def coverage(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0, F.col("value")))
    return metrics.coverage(p, panel.region_counts(S.fine_region(spark, sf_dir))).select("geo", "indicator", "year", "have", "n_regions", round_half_up("share", 6).alias("share"))


RANK = "CAST(row_number() OVER (PARTITION BY geo, indicator, year ORDER BY value DESC, region_id) AS INTEGER) AS pos"


@register("rank_regions", f"SELECT *, {RANK}, count(*) OVER (PARTITION BY geo, indicator, year) AS n FROM fine")
def rank_regions(spark, sf_dir):
    return metrics.rank_regions(S.fine_panel(spark, sf_dir))


@register(
    "top_k",
    f""", q AS (SELECT *, {RANK}, count(*) OVER (PARTITION BY geo, indicator, year) AS n FROM fine)
SELECT geo, indicator, year, pos, region_id, coalesce(label, region_id) AS label, value, n FROM q LEFT JOIN fine_region USING (geo, region_id) WHERE pos <= 22""",
)
def top_k(spark, sf_dir):
    p, region, _ = _fine(spark, sf_dir)
    return metrics.top_k(p, region)


@register("latest_year", "SELECT geo, indicator, max(year) AS year FROM fine GROUP BY ALL")
def latest_year(spark, sf_dir):
    return metrics.latest_year(S.fine_panel(spark, sf_dir))


@register(
    "top_by_latest_weight",
    """, l AS (SELECT geo, region_id, value FROM fine WHERE indicator = 'qty' QUALIFY year = max(year) OVER (PARTITION BY geo)),
q AS (SELECT r.geo, r.region_id, r.label, coalesce(l.value, 0) AS weight, CAST(row_number() OVER (PARTITION BY r.geo ORDER BY coalesce(l.value, 0) DESC, r.region_id) AS INTEGER) AS pos FROM fine_region r LEFT JOIN l USING (geo, region_id))
SELECT *, pos <= 3 AS highlighted FROM q WHERE pos <= 24""",
)
def top_by_latest_weight(spark, sf_dir):
    p, region, _ = _fine(spark, sf_dir)
    return metrics.top_by_latest_weight(p, region, "qty")


@register(
    "value_table",
    f""", {W_QTY}, v AS (SELECT * FROM fine WHERE indicator = 'avg_discount' AND year >= 1998), s AS (SELECT DISTINCT geo, indicator, year FROM v)
SELECT s.geo, s.indicator, s.year, r.region_id, r.label, v.value, w.w,
       CAST(row_number() OVER (PARTITION BY s.geo, s.indicator, s.year ORDER BY v.value DESC NULLS LAST, r.region_id) AS INTEGER) AS row
FROM s JOIN fine_region r USING (geo) LEFT JOIN v ON v.geo = s.geo AND v.indicator = s.indicator AND v.year = s.year AND v.region_id = r.region_id
LEFT JOIN weights w ON w.geo = s.geo AND w.year = s.year AND w.region_id = r.region_id""",
)
def value_table(spark, sf_dir):
    p, region, _ = _fine(spark, sf_dir)
    return metrics.value_table(region, p.where("indicator = 'avg_discount' and year >= 1998"), _weights(p, "qty"))


@register(
    "missing_regions",
    """, w AS (SELECT geo, year, region_id, value - 40 AS w FROM fine WHERE indicator = 'qty'), s AS (SELECT DISTINCT geo, year FROM w)
SELECT s.geo, 'qty' AS weight, s.year, r.region_id FROM s JOIN fine_region r USING (geo) LEFT JOIN w ON w.geo = s.geo AND w.year = s.year AND w.region_id = r.region_id AND w.w > 0 WHERE w.w IS NULL""",
)
def missing_regions(spark, sf_dir):
    p, region, _ = _fine(spark, sf_dir)
    return metrics.missing_regions(region, _weights(p, "qty").withColumn("w", F.col("w") - 40)).select("geo", "weight", "year", "region_id")


@register(
    "weight_share",
    f""", {W_QTY} SELECT geo || '|' || year AS map_id, region_id, w, sum(w) OVER m AS total, {r("w / sum(w) OVER m", 9)} AS share, {r("sum(w) OVER m / 1000", 6)} AS per_tile FROM weights WINDOW m AS (PARTITION BY geo, year)""",
)
def weight_share(spark, sf_dir):
    w = _weights(S.fine_panel(spark, sf_dir), "qty").withColumn("map_id", F.concat_ws("|", "geo", "year"))
    out = metrics.weight_share(w, 1000)
    return out.select("map_id", "region_id", "w", "total", round_half_up("share", 9).alias("share"), round_half_up("per_tile", 6).alias("per_tile"))


@register("series_last_point", "SELECT geo, indicator, region_id, max(year) AS year, arg_max(value, year) AS value FROM fine GROUP BY ALL")
def series_last_point(spark, sf_dir):
    return metrics.series_last_point(S.fine_panel(spark, sf_dir))


CUTS = "quantile_cont(value, [1/7, 2/7, 3/7, 4/7, 5/7, 6/7])"


@register(
    "class_breaks",
    f""", e AS (SELECT geo, indicator, year, list_concat(list_concat([min(value)], {CUTS}), [max(value)]) AS e FROM fine GROUP BY ALL)
SELECT geo, indicator, year, CAST(c AS INTEGER) AS class, {r("e[c + 1]", 6)} AS "from", {r("e[c + 2]", 6)} AS "to" FROM e, range(7) t(c)""",
)
def class_breaks(spark, sf_dir):
    out = classify.class_breaks(S.fine_panel(spark, sf_dir))
    return out.select("geo", "indicator", "year", "class", round_half_up("from", 6).alias("from"), round_half_up("to", 6).alias("to"))


@register("diverging_spread", f"SELECT geo, indicator, year, {r('greatest(abs(min(value) - 100), abs(max(value) - 100), 1)', 6)} AS spread, {r('greatest(abs(min(value) - 100), abs(max(value) - 100), 1) / 3', 6)} AS step FROM panel WHERE indicator = 'price_index' GROUP BY ALL")
def diverging_spread(spark, sf_dir):
    out = classify.diverging_spread(S.coarse_panel(spark, sf_dir).where("indicator = 'price_index'"))
    return out.select("geo", "indicator", "year", round_half_up("spread", 6).alias("spread"), round_half_up("step", 6).alias("step"))


@register(
    "diverging_ranges",
    f""", s AS (SELECT geo, indicator, year, greatest(abs(min(value) - 100), abs(max(value) - 100), 1) / 3 AS step FROM panel WHERE indicator = 'price_index' GROUP BY ALL)
SELECT geo, indicator, year, CAST(c AS INTEGER) AS class, {r("CASE WHEN c < 0 THEN 100 + c * step WHEN c = 0 THEN 100 - step / 2 ELSE 100 + (c - 1) * step END", 6)} AS "from",
       {r("CASE WHEN c < 0 THEN 100 + (c + 1) * step WHEN c = 0 THEN 100 + step / 2 ELSE 100 + c * step END", 6)} AS "to" FROM s, range(-3, 4) t(c)""",
)
def diverging_ranges(spark, sf_dir):
    out = classify.diverging_ranges(S.coarse_panel(spark, sf_dir).where("indicator = 'price_index'"))
    return out.select("geo", "indicator", "year", "class", round_half_up("from", 6).alias("from"), round_half_up("to", 6).alias("to"))


CLASSIFIED = f"""cuts AS (SELECT geo, indicator, year, {CUTS} AS cuts, greatest(abs(min(value) - 100), abs(max(value) - 100), 1) / 3 AS step FROM {{panel}} GROUP BY ALL),
classified AS (SELECT p.geo, p.indicator, p.year, p.region_id, p.value, i.kind, CAST(CASE WHEN i.kind <> 'index' THEN len(list_filter(cuts, lambda c: p.value > c))
  WHEN abs((value - 100) / step) < 0.5 THEN 0 ELSE sign(value - 100) * least(3, ceil(abs((value - 100) / step))) END AS INTEGER) AS class
  FROM {{panel}} p JOIN cuts USING (geo, indicator, year) JOIN {{indicator}} i USING (geo, indicator))"""


@register("classified", f", {CLASSIFIED.format(panel='panel', indicator='indicator_dim')} SELECT * FROM classified")
def classified(spark, sf_dir):
    p, _, i = _both(spark, sf_dir)
    return classify.classified(p, i)


@register("bivariate_slice", f", {W_QTY}, {CLASSIFIED.format(panel='fine', indicator='fine_indicator')} SELECT c.geo, c.indicator, c.year, weight, c.region_id, w, value, class FROM classified c JOIN weights USING (geo, year, region_id) WHERE w > 0")
def bivariate_slice(spark, sf_dir):
    p, _, i = _fine(spark, sf_dir)
    return classify.bivariate_slice(p, _weights(p, "qty"), i)


BASE = """years AS (SELECT geo, indicator, year, count(*) FILTER (value > 60) AS have FROM fine GROUP BY ALL), """
BASE_RULE = """l AS (SELECT *, arg_max(have, year) OVER (PARTITION BY geo, indicator) AS latest FROM years),
base AS (SELECT geo, indicator, min(year) FILTER (latest = 0 OR have >= 0.9 * latest) AS base_year, min(year) AS first_year, max(year) AS last_year, max(latest) AS latest_have,
  arg_min(have, year) FILTER (latest = 0 OR have >= 0.9 * latest) AS base_have, count(*) AS n_years FROM l GROUP BY ALL)"""
BASE += BASE_RULE


def _sparse(spark, sf_dir):
    return S.fine_panel(spark, sf_dir).withColumn("value", F.when(F.col("value") > 60, F.col("value")))


@register("choose_base_year", f", {BASE} SELECT * FROM base")
def choose_base_year(spark, sf_dir):
    return trend.choose_base_year(_sparse(spark, sf_dir), S.fine_region(spark, sf_dir))


@register(
    "index_to_base",
    f""", {BASE}, p AS (SELECT f.*, base_year, max(CASE WHEN year = base_year THEN value END) OVER (PARTITION BY geo, indicator, region_id) AS b FROM fine f JOIN base USING (geo, indicator) WHERE value > 60 AND year >= base_year)
SELECT geo, indicator, region_id, year, {r("value / b * 100", 6)} AS value FROM p WHERE b IS NOT NULL""",
)
def index_to_base(spark, sf_dir):
    p = _sparse(spark, sf_dir)
    return trend.index_to_base(p, trend.choose_base_year(p, S.fine_region(spark, sf_dir))).withColumn("value", round_half_up("value", 6))


@register("trend_domain", "SELECT geo, indicator, min(value) AS low, max(value) AS high, min(year) AS first_year, max(year) AS last_year FROM fine GROUP BY ALL")
def trend_domain(spark, sf_dir):
    return trend.trend_domain(S.fine_panel(spark, sf_dir))


@register(
    "trend_coverage",
    """, s AS (SELECT geo, indicator, region_id FROM fine WHERE value > 60 GROUP BY ALL HAVING count(*) > 1)
SELECT geo, indicator, count(*) AS kept, n_regions FROM s JOIN fine_n USING (geo) GROUP BY geo, indicator, n_regions""",
)
def trend_coverage(spark, sf_dir):
    series = trend.index_to_base(_sparse(spark, sf_dir), None, indexed=False)
    return trend.trend_coverage(series, panel.region_counts(S.fine_region(spark, sf_dir)))


NONE = "CAST(NULL AS {}) AS {}"


@register(
    "missing_fields",
    """, m(rule, field) AS (VALUES (1, 'unit'), (2, 'decimals'), (3, 'sourceUrl'), (4, 'kind'), (4, 'label'), (5, 'source'))
SELECT 'missing field' AS "check", geo, indicator, CAST(NULL AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS region_id, field AS detail FROM fine_indicator
JOIN m ON rule = CASE WHEN indicator = 'qty' THEN CAST(right(geo, 1) AS INTEGER) ELSE 5 END""",
)
def missing_fields(spark, sf_dir):
    rule = F.when(F.col("indicator") == "qty", F.substring("geo", -1, 1).cast("int")).otherwise(5)
    without = {"unit": 1, "decimals": 2, "source_url": 3, "kind": 4, "label": 4, "source": 5}
    i = S.fine_indicator(spark, sf_dir).withColumn("_rule", rule)
    return quality.missing_fields(i.withColumns({c: F.when(F.col("_rule") != k, F.col(c)) for c, k in without.items()}))


@register(
    "unknown_kinds",
    """SELECT 'unknown kind' AS "check", geo, indicator, CAST(NULL AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS region_id, CASE WHEN geo < 'Brand#3' THEN 'share' ELSE 'missing' END AS detail
FROM fine_indicator WHERE indicator = 'avg_discount'""",
)
def unknown_kinds(spark, sf_dir):
    i = S.fine_indicator(spark, sf_dir)
    odd = F.when(F.col("geo") < "Brand#3", "share")  # else null
    return quality.unknown_kinds(i.withColumn("kind", F.when(F.col("kind") == "rate", odd).otherwise(F.col("kind"))))


@register("unknown_regions", "SELECT 'unknown region' AS \"check\", geo, indicator, year, region_id, region_id AS detail FROM fine WHERE region_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 5)")
def unknown_regions(spark, sf_dir):
    known = S.read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_brand").alias("geo"), F.col("p_partkey").cast("string").alias("region_id"))
    return quality.unknown_regions(S.fine_panel(spark, sf_dir), known)


@register("non_finite_values", "SELECT 'non-finite value' AS \"check\", geo, indicator, year, region_id, 'NaN' AS detail FROM fine WHERE value > 150")
def non_finite_values(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir)
    return quality.non_finite_values(p.withColumn("value", F.when(F.col("value") > 150, F.lit(float("nan"))).otherwise(F.col("value"))))


@register("negative_counts", "SELECT 'negative count' AS \"check\", geo, indicator, year, region_id, CAST(CAST(value - 20 AS BIGINT) AS VARCHAR) AS detail FROM fine WHERE indicator = 'qty' AND value < 20")
def negative_counts(spark, sf_dir):
    p, _, i = _fine(spark, sf_dir)
    return quality.negative_counts(p.withColumn("value", F.col("value") - 20), i).withColumn("detail", F.col("detail").cast("double").cast("long").cast("string"))


#: Few regions have values before 1994, and some indicators a single year.
UNEVEN = f"""uneven AS (SELECT geo, indicator, year, region_id, CASE WHEN year >= 1994 OR CAST(region_id AS BIGINT) % 3 = 0 THEN value END AS value FROM fine
  WHERE indicator = 'qty' OR geo >= 'Brand#2' OR year = 1995),
years AS (SELECT geo, indicator, year, count(value) AS have FROM uneven GROUP BY ALL), {BASE_RULE}"""


def _uneven(spark, sf_dir):
    p = S.fine_panel(spark, sf_dir).where("indicator = 'qty' or geo >= 'Brand#2' or year = 1995")
    return p.withColumn("value", F.when((F.col("year") >= 1994) | (F.col("region_id").cast("long") % 3 == 0), F.col("value")))


NOTES = f""", {UNEVEN}, n AS (SELECT 'base year moved' AS "check", geo, indicator, base_year AS year, first_year AS d FROM base WHERE base_year <> first_year AND base_have >= 0.85 * latest_have
UNION ALL SELECT 'base year covers too little', geo, indicator, base_year, base_have FROM base WHERE base_have < 0.85 * latest_have UNION ALL SELECT 'single year', geo, indicator, base_year, n_years FROM base WHERE n_years = 1)
SELECT "check", geo, indicator, year, CAST(NULL AS VARCHAR) AS region_id, CAST(d AS VARCHAR) AS detail FROM n"""


@register("trend_notes", NOTES)
def trend_notes(spark, sf_dir):
    return quality.trend_notes(_uneven(spark, sf_dir), S.fine_region(spark, sf_dir))


@register("trend_notes_low_bar", NOTES.replace("0.9 *", "0.2 *"))
def trend_notes_low_bar(spark, sf_dir):
    """With a lower bar a base year may cover too little."""
    return quality.trend_notes(_uneven(spark, sf_dir), S.fine_region(spark, sf_dir), bar=0.2)


@register(
    "no_shared_year",
    f""", {PAIRS}, p AS (SELECT DISTINCT geo, indicator, year FROM fine WHERE (indicator = 'qty' AND year > 1997) OR (indicator <> 'qty' AND year < CASE WHEN geo < 'Brand#3' THEN 1997 ELSE 1999 END))
SELECT 'no shared year' AS "check", geo, indicator, CAST(NULL AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS region_id, weight AS detail FROM pairs q
WHERE NOT EXISTS (SELECT 1 FROM p a JOIN p b ON a.geo = b.geo AND a.year = b.year WHERE a.geo = q.geo AND a.indicator = q.indicator AND b.indicator = q.weight)""",
)
def no_shared_year(spark, sf_dir):
    p, _, i = _fine(spark, sf_dir)
    p = p.where("(indicator = 'qty' and year > 1997) or (indicator <> 'qty' and year < case when geo < 'Brand#3' then 1997 else 1999 end)")
    return quality.no_shared_year(p, _pairs(i))


@register(
    "format_value",
    """SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', floor(o_totalprice * 100 + 0.5) / 100), ',', '_'), '.', ','), '_', '.') || ' EUR' AS text,
  CASE WHEN o_totalprice * 20 >= 1e6 THEN format('{:.1f}', floor(o_totalprice * 20 / 1e6 * 10 + 0.5) / 10) || ' M' WHEN o_totalprice * 20 >= 1e4 THEN CAST(CAST(floor(o_totalprice * 20 / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || ' k'
  ELSE replace(format('{:,.0f}', floor(o_totalprice * 20 + 0.5)), ',', '.') END AS compact FROM orders""",
)
def format_value(spark, sf_dir):
    return S.read(spark, sf_dir, "orders").select("o_orderkey", C.format_value("o_totalprice", 2, F.lit("EUR")).alias("text"), C.format_compact(F.col("o_totalprice") * 20, 0).alias("compact"))


def minimum_slice(spark, sf_dir):
    """Per geography and year: regions ranked by revenue, their quantile class, the headline and coverage."""
    p, region, i = _both(spark, sf_dir)
    p = written(p, "panel")  # some rows a nation and year: aggregated once, read six times
    revenue = p.where("indicator = 'revenue'")
    ranked = metrics.rank_regions(revenue)
    classes = classify.classified(revenue, i).select("geo", "year", "region_id", "class")
    heads = metrics.headline(revenue, _weights(p), i).select("geo", "year", round_half_up("value", 2).alias("headline"))
    covered = metrics.coverage(revenue, panel.region_counts(region)).select("geo", "year", round_half_up("share", 6).alias("coverage"))
    return ranked.join(classes, ["geo", "year", "region_id"]).join(heads, ["geo", "year"]).join(covered, ["geo", "year"]).select(
        "geo", "year", "region_id", "value", "pos", "n", "class", "headline", "coverage"
    )


register(
    "minimum_slice",
    f""", q AS (SELECT * FROM panel WHERE indicator = 'revenue'), {CLASSIFIED.format(panel='q', indicator='indicator_dim')}
SELECT c.geo, c.year, c.region_id, c.value, CAST(row_number() OVER (PARTITION BY c.geo, c.year ORDER BY c.value DESC, c.region_id) AS INTEGER) AS pos, count(*) OVER s AS n, c.class,
  {r("sum(c.value) OVER s", 2)} AS headline, {r("count(*) OVER s / n_regions", 6)} AS coverage FROM classified c JOIN n_regions USING (geo) WINDOW s AS (PARTITION BY c.geo, c.year)""",
)(minimum_slice)
