"""Queries that describe tables and cohorts: shapes, histograms, codes and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import encode
from ..functions.text import any_like
from ..operators.describe import age_at, distinct_labels, histogram, shape, years_histogram
from ..operators.events import first_occurrence
from ..operators.pca import covariance, pca_fit, pca_scores
from ..sources.tables import first_row
from . import fixtures as fx
from .cohorts import cohort
from .registry import query


def _bins_sql(values: str, bins: int = 10) -> str:
    """Histogram of the column `v` of a CTE: edges decide, the last bin is closed."""
    return f"""m AS (SELECT coalesce(min(v), 0) AS a, coalesce(max(v), 1) AS z FROM {values}),
    s AS (SELECT CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi FROM m),
    b AS (SELECT lo, hi, (hi - lo) / {bins} AS w FROM s),
    edges AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * w AS lo,
      CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * w END AS hi, i = {bins - 1} AS closed
      FROM b, range({bins}) r(i)),
    bins AS (SELECT bin, round(min(e.lo), 6) AS lo, round(min(e.hi), 6) AS hi, count(v) AS n
      FROM edges e LEFT JOIN {values} ON v >= e.lo AND (v < e.hi OR (closed AND v = e.hi)) GROUP BY bin)"""


def _rounded(df):
    return df.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query(
    "time_histogram",
    f"""WITH d AS (SELECT floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) / 365.2425::DOUBLE AS v
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {_bins_sql('d')} SELECT * FROM bins""",
)
def time_histogram(t):
    return _rounded(years_histogram(fx.lines_with_orders(t), F.col("o_orderdate"), F.col("l_shipdate")))


@query(
    "age_histogram",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}, d AS (
      SELECT floor((epoch_us(ts) - epoch_us(birthday)) / 86400000000) / 365.2425::DOUBLE AS v
      FROM idx WHERE birthday IS NOT NULL), {_bins_sql('d')} SELECT * FROM bins""",
)
def age_histogram(t):
    index = first_occurrence(fx.events(t), fx.INDEX)
    return _rounded(years_histogram(index, F.col("birthday"), F.col("ts")))


@query(
    "follow_up_histogram",
    f"""WITH {fx.COHORT_SQL}, d AS (
      SELECT floor((epoch_us(end_time) - epoch_us(index_time)) / 86400000000) / 365.2425::DOUBLE AS v
      FROM cohort WHERE end_time IS NOT NULL), {_bins_sql('d')} SELECT * FROM bins""",
)
def follow_up_histogram(t):
    return _rounded(years_histogram(cohort(t), F.col("index_time"), F.col("end_time")))


@query("price_histogram", f"WITH d AS (SELECT l_extendedprice AS v FROM lineitem), {_bins_sql('d', 20)} SELECT * FROM bins")
def price_histogram(t):
    return _rounded(histogram(t.lineitem, F.col("l_extendedprice"), 20))


@query(
    "age_at_index",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL} SELECT master, eid,
      round(floor((epoch_us(ts) - epoch_us(birthday)) / 86400000000) / 365.2425::DOUBLE, 9) AS age FROM idx""",
)
def age_at_index(t):
    index = first_occurrence(fx.events(t), fx.INDEX)
    return index.select("master", "eid", F.round(age_at(F.col("birthday"), F.col("ts")), 9).alias("age"))


@query(
    "category_encode",
    """SELECT c_custkey, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS unmapped,
      CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS code FROM customer""",
)
def category_encode(t):
    codes = {"BUILDING": 0, "MACHINERY": 1}
    code = encode(F.col("c_mktsegment"), codes)
    return t.customer.select("c_custkey", code.isNull().alias("unmapped"), F.coalesce(code, F.lit(-1)).alias("code"))


@query(
    "text_patterns",
    """SELECT lang, count(*) AS n FROM documents
    WHERE text LIKE '%tion%ment%' OR text LIKE 'The%on%on.' OR text LIKE '%@%.com%' GROUP BY lang""",
)
def text_patterns(t):
    hit = any_like(F.col("text"), ["%tion%ment%", "The%on%on.", "%@%.com%"])
    return t.documents.filter(hit).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "table_shape",
    """SELECT (SELECT count(*) FROM lineitem) AS n_rows, CAST(count(*) AS INTEGER) AS n_columns,
      string_agg(column_name, ',' ORDER BY column_name) AS names
    FROM (SELECT DISTINCT column_name FROM information_schema.columns WHERE table_name = 'lineitem')""",
)
def table_shape(t):
    return shape(t.lineitem).select("n_rows", "n_columns", F.array_join(F.array_sort("columns"), ",").alias("names"))


@query("first_row", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def earliest_order(t):
    return first_row(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("distinct_labels", "SELECT DISTINCT label FROM embeddings")
def labels(t):
    return distinct_labels(t.embeddings, "label")


_COVARIANCE = """x AS (
  SELECT vec_id, i - 1 AS f, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, (SELECT len(embedding) + 1 FROM embeddings LIMIT 1)) r(i)),
m AS (SELECT f, avg(v) AS mean FROM x GROUP BY f),
c AS (SELECT vec_id, x.f, v - mean AS v FROM x JOIN m ON x.f = m.f),
cov AS (
  SELECT CAST(a.f AS INTEGER) AS i, CAST(b.f AS INTEGER) AS j,
         sum(a.v * b.v) / ((SELECT count(*) FROM embeddings) - 1) AS cov
  FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.f <= b.f GROUP BY 1, 2)"""


@query("pca_covariance", f"WITH {_COVARIANCE} SELECT i, j, round(cov, 9) AS cov FROM cov")
def pca_covariance(t):
    return covariance(t.embeddings, "embedding").withColumn("cov", F.round("cov", 9))


def _eigen_sql(components: int = 2, squarings: int = 16) -> str:
    """The first components by repeated squaring: the 2**k-th power of a covariance matrix is, up to a
    factor, the product of its first unit vector with itself. Each component is then taken out."""
    parts = [f"{_COVARIANCE}, c1 AS MATERIALIZED (SELECT i, j, cov AS v FROM cov UNION ALL SELECT j, i, cov FROM cov WHERE i < j)"]
    for n in range(1, components + 1):
        parts.append(f"p{n}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM c{n}) AS v FROM c{n})")
        for k in range(1, squarings + 1):
            parts.append(
                f"q{n}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{n}_{k - 1} a JOIN p{n}_{k - 1} b ON a.j = b.i GROUP BY 1, 2), "
                f"p{n}_{k} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM q{n}_{k}) AS v FROM q{n}_{k})"
            )
        last = f"p{n}_{squarings}"
        parts.append(
            f"u{n} AS MATERIALIZED (SELECT i AS f, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)), "
            f"e{n} AS MATERIALIZED (SELECT f, v / (SELECT sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) FROM u{n}) AS v FROM u{n}), "
            f"l{n} AS MATERIALIZED (SELECT sum(x.v * c.v * y.v) AS value FROM c1 c JOIN e{n} x ON c.i = x.f JOIN e{n} y ON c.j = y.f), "
            f"c{n + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - value * x.v * y.v AS v FROM c{n} c JOIN e{n} x ON c.i = x.f JOIN e{n} y ON c.j = y.f, l{n})"
        )
    return ", ".join(parts) + ", trace AS (SELECT sum(v) AS total FROM c1 WHERE i = j)"


_EIGEN = _eigen_sql()
_SPECTRUM = """SELECT 1 AS component, round(value / total, 6) AS ratio, round(value / total, 6) AS cumulative FROM l1, trace
    UNION ALL SELECT 2, round(l2.value / total, 6), round((l1.value + l2.value) / total, 6) FROM l1, l2, trace"""
_SCORES = """s AS (SELECT vec_id, sum(c.v * e1.v) AS pc1, sum(c.v * e2.v) AS pc2 FROM c JOIN e1 USING (f) JOIN e2 USING (f) GROUP BY vec_id)"""


def _spectrum(fitted, spark):
    return fitted.spectrum(spark).select(
        "component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative")
    )


@query("pca_spectrum")
def pca_spectrum(t):
    """All components; SQL has no decomposition, so tests compare it with numpy."""
    return _spectrum(pca_fit(t.embeddings, "embedding"), t.spark)


@query("pca_spectrum_two", f"WITH {_EIGEN} {_SPECTRUM}")
def pca_spectrum_two(t):
    return _spectrum(pca_fit(t.embeddings, "embedding", 2), t.spark)


@query("pca_fraction")
def pca_fraction(t):
    """As many components as explain more than half of the variance; compared with numpy."""
    return _spectrum(pca_fit(t.embeddings, "embedding", 0.5), t.spark)


@query(
    "pca_fraction_small",
    f"""WITH {_EIGEN}, spectrum AS ({_SPECTRUM})
    SELECT * FROM spectrum WHERE component = 1 OR (SELECT ratio FROM spectrum WHERE component = 1) <= 0.001""",
)
def pca_fraction_small(t):
    """As many components as explain more than a thousandth of the variance."""
    return _spectrum(pca_fit(t.embeddings, "embedding", 0.001), t.spark)


def _loadings_sql(components: int) -> str:
    return f"WITH {_eigen_sql(components)} " + " UNION ALL ".join(
        f"SELECT {k} AS component, f AS feature, round(v, 6) AS loading FROM e{k}" for k in range(1, components + 1)
    )


@query("pca_loadings", _loadings_sql(5))
def pca_loadings(t):
    return pca_fit(t.embeddings, "embedding", 5).loadings(t.spark).withColumn("loading", F.round("loading", 6))


@query("pca_loadings_two", _loadings_sql(2))
def pca_loadings_two(t):
    return pca_fit(t.embeddings, "embedding", 2).loadings(t.spark).withColumn("loading", F.round("loading", 6))


@query(
    "pca_scores",
    f"""WITH {_EIGEN}, {_SCORES} SELECT vec_id, label, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2
    FROM s JOIN embeddings USING (vec_id)""",
)
def scores(t):
    fitted = pca_fit(t.embeddings, "embedding", 2)
    rows = pca_scores(t.embeddings, fitted, "embedding", ["vec_id", "label"])
    return rows.withColumns({"pc1": F.round("pc1", 6), "pc2": F.round("pc2", 6)})


@query(
    "pca_power_sums",
    f"""WITH {_COVARIANCE}, c1 AS MATERIALIZED (SELECT i, j, cov AS v FROM cov UNION ALL SELECT j, i, cov FROM cov WHERE i < j),
    c2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c1 a JOIN c1 b ON a.j = b.i GROUP BY 1, 2),
    t AS (SELECT sum(v) AS total FROM c1 WHERE i = j)
    SELECT round((SELECT sum(v) FROM c2 WHERE i = j) / (total * total), 9) AS second,
      round((SELECT sum(a.v * b.v) FROM c2 a JOIN c1 b USING (i, j)) / (total ** 3), 9) AS third,
      round((SELECT sum(v * v) FROM c2) / (total ** 4), 9) AS fourth FROM t""",
)
def pca_power_sums(t):
    """Power sums of the variances of all scores are traces of powers of the covariance matrix,
    which holds for no other rotation."""
    rows = pca_scores(t.embeddings, pca_fit(t.embeddings, "embedding"), "embedding", [])
    variances = rows.agg(F.array(*[F.var_samp(c) for c in rows.columns]).alias("v"))

    def power(p: int):
        total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
        return F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(p))) / F.pow(total, F.lit(p)), 9)

    return variances.select(power(2).alias("second"), power(3).alias("third"), power(4).alias("fourth"))


@query(
    "pca_score_norms",
    f"WITH {_COVARIANCE} SELECT vec_id, round(sum(v * v), 6) AS norm FROM c GROUP BY vec_id",
)
def pca_score_norms(t):
    """All components together keep the distance of each row from the mean."""
    fitted = pca_fit(t.embeddings, "embedding")
    rows = pca_scores(t.embeddings, fitted, "embedding", ["vec_id"])
    names = [c for c in rows.columns if c != "vec_id"]
    return rows.select("vec_id", F.round(sum(F.col(c) * F.col(c) for c in names), 6).alias("norm"))


@query(
    "pca_score_moments",
    f"""WITH {_COVARIANCE}, full_cov AS (SELECT i, j, cov FROM cov UNION ALL SELECT j, i, cov FROM cov WHERE i < j),
    total AS (SELECT sum(cov) AS trace FROM cov WHERE i = j)
    SELECT round(max(trace), 6) AS total_variance,
           round(sum(cov * cov) / max(trace * trace), 9) AS squared_ratios FROM full_cov, total""",
)
def pca_score_moments(t):
    """Variances of the scores: their sum is the trace of the covariance matrix, and the sum of
    squared ratios its squared norm over the squared trace."""
    fitted = pca_fit(t.embeddings, "embedding")
    rows = pca_scores(t.embeddings, fitted, "embedding", ["vec_id"])
    names = [c for c in rows.columns if c != "vec_id"]
    variances = rows.agg(F.array(*[F.var_samp(c) for c in names]).alias("v"))
    ratios = F.array(*[F.lit(float(r)) for r in fitted.ratios])
    add = lambda a, b: a + b
    return variances.select(
        F.round(F.aggregate("v", F.lit(0.0), add), 6).alias("total_variance"),
        F.round(F.aggregate(F.transform(ratios, lambda r: r * r), F.lit(0.0), add), 9).alias("squared_ratios"),
    )


@query(
    "label_scores",
    f"""WITH {_EIGEN}, {_SCORES} SELECT label, count(*) AS n, round(avg(pc1), 6) AS mean1, round(avg(pc2), 6) AS mean2,
      round(avg(pc1 * pc1), 6) AS square1, round(avg(pc2 * pc2), 6) AS square2 FROM s JOIN embeddings USING (vec_id) GROUP BY label""",
)
def label_scores(t):
    """Moments of the scores per label: every label is kept, however many there are."""
    fitted = pca_fit(t.embeddings, "embedding", 2)
    rows = pca_scores(t.embeddings, fitted, "embedding", ["label"])
    return rows.groupBy("label").agg(
        F.count("pc1").alias("n"), *[F.round(F.avg(f"pc{k}"), 6).alias(f"mean{k}") for k in (1, 2)],
        *[F.round(F.avg(F.col(f"pc{k}") * F.col(f"pc{k}")), 6).alias(f"square{k}") for k in (1, 2)],
    )
