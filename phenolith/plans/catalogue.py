"""Queries over the driver's tables, each through the library's verbs, and the SQL that gives the same rows.

Tables become profiles by renaming: keys and labels are metadata, measures are
features of compartments.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.linalg import moments, pairwise, triangle
from phenolith.operators.aggregate import aggregate
from phenolith.operators.annotate import annotate
from phenolith.operators.consensus import consensus
from phenolith.operators.images import aggregate_image_features, count_fields, extract_image_features
from phenolith.operators.locations import nested_centres
from phenolith.operators.normalize import _AS241, inverse_normal, normalize
from phenolith.operators.select import correlation_threshold, count_na, feature_select, frequency_threshold, na_columns, noise_removal, outlier_features, value_counts, variance_threshold
from phenolith.operators.single_cell import SingleCells, sample_fraction, sample_number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_LINE = {"l_orderkey": "Metadata_order", "l_linenumber": "Metadata_line", "l_returnflag": "Metadata_flag", "l_linestatus": "Metadata_status", "l_quantity": "Cells_quantity", "l_extendedprice": "Cells_price", "l_discount": "Nuclei_discount", "l_tax": "Cytoplasm_tax"}
FEATURES = ["Cells_quantity", "Cells_price", "Nuclei_discount", "Cytoplasm_tax"]
_SOURCE = {v: k for k, v in _LINE.items()}


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(*[F.col(a).alias(b) for a, b in _LINE.items()])


LINES = "lines AS (SELECT " + ", ".join(f"{a} AS {b}" for a, b in _LINE.items()) + " FROM lineitem)"
STRATA = ["Metadata_flag", "Metadata_status"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def _each(form: str, columns=FEATURES) -> str:
    return ", ".join(form.format(c=c) + f" AS {c}" for c in columns)


def listing(spark: SparkSession, features: list[str], excluded: list[str]) -> DataFrame:
    """(feature, excluded): what a selection decided; one row a feature."""
    return spark.createDataFrame([(c, c in set(excluded)) for c in features], "feature string, excluded boolean")


def _listing_sql(cases: str, extra: str = "") -> str:
    return f"WITH {LINES}{extra} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {cases.format(c=c)} AS excluded" for c in FEATURES)


# aggregation

for _how, _sql in (("median", "median"), ("mean", "avg")):
    query(f"aggregate_{_how}", f"WITH {LINES} SELECT Metadata_flag, Metadata_status, {_each('round(' + _sql + '({c}), 4)')} FROM lines GROUP BY ALL")(lambda spark, d, how=_how: rounded(aggregate(lines(spark, d), strata=STRATA, operation=how)))


@query("aggregate_count", f"WITH {LINES} SELECT Metadata_flag, count(Metadata_line) AS Metadata_Object_Count, {_each('round(avg({c}), 4)')} FROM lines GROUP BY ALL")
def _(spark, d):
    return rounded(aggregate(lines(spark, d), strata=["Metadata_flag"], operation="mean", compute_object_count=True, object_feature="Metadata_line"))


@query("aggregate_null_strata", f"WITH {LINES} SELECT g AS Metadata_g, CASE WHEN g IS NOT NULL THEN count(Metadata_line) END AS Metadata_Object_Count, {_each('round(median({c}), 4)')} FROM (SELECT *, nullif(Metadata_flag, 'N') AS g FROM lines) GROUP BY g")
def _(spark, d):
    df = lines(spark, d).withColumn("Metadata_g", F.when(F.col("Metadata_flag") != "N", F.col("Metadata_flag")))
    return rounded(aggregate(df, strata=["Metadata_g"], compute_object_count=True, object_feature="Metadata_line"))


@query("aggregate_subset", f"WITH {LINES}, s AS (SELECT DISTINCT Metadata_order, Metadata_flag FROM lines WHERE Metadata_line = 1) SELECT Metadata_flag, Metadata_status, {_each('round(median({c}), 4)')} FROM lines JOIN s USING (Metadata_order, Metadata_flag) GROUP BY ALL")
def _(spark, d):
    df = lines(spark, d)
    chosen = df.filter("Metadata_line = 1").select("Metadata_order", "Metadata_flag").distinct()
    return rounded(aggregate(df, strata=STRATA, subset_data_df=chosen))


# annotation


@query("annotate_platemap", "SELECT n_name AS Metadata_n_name, n_regionkey AS Metadata_n_regionkey, s_suppkey AS Metadata_supplier, s_nationkey AS Metadata_nation, s_acctbal AS Cells_balance FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def _(spark, d):
    profiles = read(spark, d, "supplier").selectExpr("s_suppkey AS Metadata_supplier", "s_nationkey AS Metadata_nation", "s_acctbal AS Cells_balance")
    return annotate(profiles, read(spark, d, "nation"), join_on=["Metadata_n_nationkey", "Metadata_nation"])


@query("annotate_external", """
WITH p AS (SELECT o_orderpriority, c_custkey, c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT DISTINCT n_name AS Metadata_n_name, c_nationkey AS Metadata_nation, c_acctbal AS Cells_balance, c_custkey AS Metadata_customer, o_orderstatus AS Metadata_o_orderstatus, o_orderpriority AS Metadata_o_orderpriority
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey
""")
def _(spark, d):
    """External metadata of one priority only, so some customers have no match."""
    return _annotated_customers(spark, d, read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"))


def _annotated_customers(spark: SparkSession, d: str, orders: DataFrame) -> DataFrame:
    profiles = read(spark, d, "customer").selectExpr("c_custkey AS Metadata_customer", "c_nationkey AS Metadata_nation", "c_acctbal AS Cells_balance")
    extra = orders.select(F.col("o_custkey").alias("Metadata_customer"), "o_orderstatus", "o_orderpriority")
    return annotate(profiles, read(spark, d, "nation").select("n_nationkey", "n_name"), join_on=["Metadata_n_nationkey", "Metadata_nation"], external_metadata=extra, external_join_on="Metadata_customer")


@query("annotate_external_all", """
SELECT DISTINCT n_name AS Metadata_n_name, c_nationkey AS Metadata_nation, c_acctbal AS Cells_balance, c_custkey AS Metadata_customer, o_orderstatus AS Metadata_o_orderstatus, o_orderpriority AS Metadata_o_orderpriority
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey
""")
def _(spark, d):
    """The whole external table; ``annotate_external`` takes one priority, which leaves customers without a match."""
    return _annotated_customers(spark, d, read(spark, d, "orders"))


@query("annotate_cmap", """
WITH p AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'DMSO' WHEN p_size < 20 THEN 'empty' WHEN p_size < 30 THEN NULL ELSE 'BRD-' || upper(substr(p_brand, 1, 1)) || p_partkey || '-x' END AS s, CAST(p_size AS DOUBLE) / 2 AS dose FROM part)
SELECT p_partkey AS Metadata_Well, 'brand' AS Metadata_note, nullif(regexp_extract(s, '(BRD[-N][A-Z0-9]+)', 1), '') AS Metadata_pert_id, s AS Metadata_pert_mfc_id, p_partkey AS Metadata_pert_well, '' AS Metadata_pert_id_vendor, 'A549' AS Metadata_cell_id,
CASE WHEN s IS NULL OR s = 'DMSO' THEN 'control' WHEN s = 'empty' THEN 'empty' ELSE 'trt' END AS Metadata_broad_sample_type, coalesce(s, 'DMSO') AS Metadata_broad_sample, CASE WHEN s IS NULL OR s = 'DMSO' THEN 0.0 ELSE dose END AS Metadata_mmoles_per_liter,
CASE WHEN s IS NULL OR s = 'DMSO' THEN 'control' WHEN s = 'empty' THEN 'empty' ELSE 'trt' END AS Metadata_pert_type, dose AS Cells_x FROM p
""")
def _(spark, d):
    part = read(spark, d, "part")
    size = F.col("p_size")
    sample = F.when(size < 10, "DMSO").when(size < 20, "empty").when(size < 30, None).otherwise(F.concat(F.lit("BRD-"), F.upper(F.substring("p_brand", 1, 1)), F.col("p_partkey").cast("string"), F.lit("-x")))
    profiles = part.select(F.col("p_partkey").alias("Metadata_Well"), (size * 0.5).cast("double").alias("Cells_x"))
    wells = part.select(F.col("p_partkey").alias("Metadata_Well"), F.lit("brand").alias("Metadata_note"), sample.alias("Metadata_broad_sample"), (size * 0.5).cast("double").alias("Metadata_mmoles_per_liter"))
    return annotate(profiles, wells, join_on="Metadata_Well", format_broad_cmap=True, cmap_args={"cell_id": "A549", "perturbation_mode": "chemical"})


# normalization

_KEYS = "Metadata_order, Metadata_line, Metadata_flag, Metadata_status"
_STD = "SELECT {keys}, " + _each("round((l.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1 ELSE s.s_{c} END, 4) + 0.0") + " FROM lines l, s"
_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)


@query("normalize_standardize", f"WITH {LINES}, s AS (SELECT {_STATS} FROM lines) {_STD.format(keys=_KEYS)}")
def _(spark, d):
    return rounded(normalize(lines(spark, d)))


@query("normalize_standardize_control", f"WITH {LINES}, s AS (SELECT {_STATS} FROM lines WHERE Metadata_flag = 'A' AND Metadata_line IN (1, 2)) {_STD.format(keys=_KEYS)}")
def _(spark, d):
    return rounded(normalize(lines(spark, d), samples="Metadata_flag == 'A' and Metadata_line in [1, 2]"))


@query("normalize_robustize", f"WITH {LINES}, s AS (SELECT {', '.join(f'median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}' for c in FEATURES)} FROM lines WHERE Metadata_flag = 'N') {_STD.format(keys=_KEYS)}")
def _(spark, d):
    return rounded(normalize(lines(spark, d), samples="Metadata_flag == 'N'", method="robustize"))


@query("normalize_mad", f"WITH {LINES}, s AS (SELECT {', '.join(f'median({c}) AS m_{c}, mad({c}) * 1.4826 + 1e-18 AS s_{c}' for c in FEATURES)} FROM lines) {_STD.format(keys=_KEYS)}")
def _(spark, d):
    return rounded(normalize(lines(spark, d), method="mad_robustize"))


@query("normalize_qc", "WITH e AS (SELECT * FROM events WHERE event_type <> 'error'), s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM e) SELECT event_id AS Metadata_id, false AS Metadata_cqc_error, round((value - m) / s, 4) + 0.0 AS Cells_value FROM e, s")
def _(spark, d):
    df = read(spark, d, "events").select(F.col("event_id").alias("Metadata_id"), (F.col("event_type") == "error").alias("Metadata_cqc_error"), F.col("value").alias("Cells_value"))
    return rounded(normalize(df, drop_cosmicqc_rows=True))


@query("normalize_tokens", "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events), s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM e) SELECT event_id AS Metadata_id, round((value - m) / s, 4) + 0.0 AS Cells_value FROM e, s")
def _(spark, d):
    df = read(spark, d, "events").select(F.col("event_id").alias("Metadata_id"), F.when(F.col("event_id") % 7 == 0, F.lit(" None ")).otherwise(F.col("value").cast("string")).alias("Cells_value"))
    return rounded(normalize(df))


def _horner(powers: tuple[float, ...], x: str) -> str:
    out = repr(powers[-1])
    for c in reversed(powers[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def _quantile_sql() -> str:
    """The normal's quantiles of the places of values among 1,000 quantiles, by the same rational approximations."""
    ratio = lambda k, x: f"({_horner(_AS241[k][0], x)} / {_horner(_AS241[k][1], x)})"
    low = float(inverse_normal(np.array([1e-7 - np.spacing(1)]))[0])
    parts = []
    for c in FEATURES:
        parts.append(f"""
g_{c} AS (SELECT q, min(k) AS f, max(k) AS l FROM (SELECT unnest(list_transform(range(1000), lambda i: i)) AS k, unnest(x) AS q FROM (SELECT quantile_cont({c}, [{", ".join(repr(float(p)) for p in np.linspace(0, 1, 1000))}]) AS x FROM lines)) GROUP BY q),
n_{c} AS (SELECT *, lead(q) OVER (ORDER BY q) AS next, min(q) OVER () AS least, max(q) OVER () AS most FROM g_{c}),
y_{c} AS (SELECT v, CASE WHEN v + 1e-7 > most THEN 1 WHEN v - 1e-7 < least THEN 0 WHEN v = q THEN (f + l) / 2.0 / 999 ELSE (l + (v - q) / (next - q)) / 999 END AS y FROM (SELECT DISTINCT {c} AS v FROM lines) ASOF JOIN n_{c} ON v >= q),
p_{c} AS (SELECT v, p, p - 0.5 AS d, sqrt(-ln(least(p, 1 - p))) AS r FROM (SELECT v, least(greatest(y, 1e-8), 1 - 1e-8) AS p FROM y_{c})),
z_{c} AS (SELECT v, round(least(greatest(CASE WHEN abs(d) <= 0.425 THEN d * {ratio(0, "(0.180625 - d * d)")} ELSE sign(d) * CASE WHEN r <= 5 THEN {ratio(1, "(r - 1.6)")} ELSE {ratio(2, "(r - 5)")} END END, {low!r}), {-low!r}), 4) + 0.0 AS z FROM p_{c})""")
    return f"WITH {LINES}, {', '.join(parts)} SELECT {_KEYS}, {', '.join(f'z_{c}.z AS {c}' for c in FEATURES)} FROM lines l {' '.join(f'JOIN z_{c} ON l.{c} = z_{c}.v' for c in FEATURES)}"


@query("normalize_inverse_normal", _quantile_sql())
def _(spark, d):
    return rounded(normalize(lines(spark, d), method="inverse_normal"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("Metadata_id"), *[F.col("embedding")[i].cast("double").alias(f"Cells_{i}") for i in range(64)])


@query("normalize_spherize", f"""WITH {LINES}, s AS (SELECT {_STATS}, corr(Cells_quantity, Cells_price) AS r, count(*) AS n FROM lines),
w AS (SELECT *, sqrt(n - 1) / (sqrt(n * (1 + r)) + 1e-6) AS a, sqrt(n - 1) / (sqrt(n * (1 - r)) + 1e-6) AS b FROM s),
x AS (SELECT l.*, a, b, (l.Cells_quantity - m_Cells_quantity) / s_Cells_quantity AS q, (l.Cells_price - m_Cells_price) / s_Cells_price AS p FROM lines l, w)
SELECT {_KEYS}, round((a + b) / 2 * q + (a - b) / 2 * p, 4) + 0.0 AS Cells_quantity, round((a - b) / 2 * q + (a + b) / 2 * p, 4) + 0.0 AS Cells_price FROM x""")
def _(spark, d):
    """Two features, for which the whitening matrix has a closed form."""
    return rounded(normalize(lines(spark, d), features=["Cells_quantity", "Cells_price"], method="spherize", spherize_method="ZCA-cor", spherize_svd_on="transformed"))


@query("normalize_spherize_vectors", "SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS covariance FROM range(64) a(i), range(64) b(j) WHERE i <= j")
def _(spark, d):
    """Whitened vectors have the identity as their covariance."""
    white = normalize(vectors(spark, d), method="spherize", spherize_method="ZCA-cor", spherize_svd_on="transformed")
    names = [f"Cells_{i}" for i in range(64)]
    r, n = triangle(white, names, moments(white, names)[1]), white.count()
    covariance = r.T @ r / (n - 1)
    return rounded(spark.createDataFrame([(i, j, float(covariance[i, j])) for i in range(64) for j in range(i, 64)], "i int, j int, covariance double"))


@query("normalize_payload", f"WITH {LINES}, s AS (SELECT avg(Cells_price) AS m, stddev_pop(Cells_price) AS s FROM lines) SELECT {_KEYS}, Nuclei_discount AS Image_payload, round((Cells_price - m) / s, 4) + 0.0 AS Cells_price FROM lines, s")
def _(spark, d):
    return rounded(normalize(lines(spark, d).withColumnRenamed("Nuclei_discount", "Image_payload"), features=["Cells_price"]))


# selection


@query("select_variance", _listing_sql("(SELECT var_pop({c}) <= 0.01 FROM lines)"))
def _(spark, d):
    return listing(spark, FEATURES, variance_threshold(lines(spark, d), min_variance=0.01))


def _holes(spark, d):
    return lines(spark, d).withColumns({"Cells_quantity": F.expr("CASE WHEN Cells_quantity > 47 THEN NULL ELSE Cells_quantity END"), "Cells_price": F.expr("CASE WHEN Metadata_line = 1 THEN double('NaN') ELSE Cells_price END")})


_HOLES = "SELECT * REPLACE (CASE WHEN Cells_quantity <= 47 THEN Cells_quantity END AS Cells_quantity, CASE WHEN Metadata_line <> 1 THEN Cells_price END AS Cells_price) FROM lines"


@query("select_na", _listing_sql("(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.1 FROM h)", f", h AS ({_HOLES})"))
def _(spark, d):
    return listing(spark, FEATURES, na_columns(_holes(spark, d), cutoff=0.1))


@query("count_na", f"WITH {LINES}, h AS ({_HOLES}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS num_na FROM h" for c in FEATURES))
def _(spark, d):
    return count_na(_holes(spark, d))


@query("select_outlier", _listing_sql("(SELECT max({c}) > 45 OR min({c}) < -45 FROM lines)"))
def _(spark, d):
    return listing(spark, FEATURES, outlier_features(lines(spark, d), outlier_cutoff=45))


_COUNTS = ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM lines WHERE {c} IS NOT NULL GROUP BY {c}" for c in FEATURES) + "), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC) AS k FROM v)"


@query("select_frequency_counts", f"WITH {LINES}{_COUNTS} SELECT feature, count(*) AS \"distinct\", max(n) AS most, coalesce(max(CASE WHEN k = 2 THEN n END), 0) AS second FROM r GROUP BY feature")
def _(spark, d):
    return value_counts(lines(spark, d), FEATURES)


@query("select_frequency", f"WITH {LINES}{_COUNTS} SELECT feature, coalesce(max(CASE WHEN k = 2 THEN n END), 0) / max(n) < 0.9 OR count(*) / (SELECT count(*) FROM lines) < 0.0005 AS excluded FROM r GROUP BY feature")
def _(spark, d):
    return listing(spark, FEATURES, frequency_threshold(lines(spark, d), freq_cut=0.9, unique_cut=0.0005))


@query("select_noise", _listing_sql("(SELECT avg(s) > 10 FROM (SELECT stddev_pop({c}) AS s FROM lines WHERE Metadata_flag IS NOT NULL GROUP BY Metadata_flag))"))
def _(spark, d):
    return listing(spark, FEATURES, noise_removal(lines(spark, d), "Metadata_flag", noise_removal_stdev_cutoff=10))


def _related(spark, d):
    return lines(spark, d).withColumns({"Nuclei_near": F.col("Cells_price") * 1.3 + F.col("Nuclei_discount") * 10000, "Nuclei_far": -F.col("Cells_price") + F.col("Cytoplasm_tax")})


_RELATED = ["Cells_quantity", "Cells_price", "Nuclei_discount", "Cytoplasm_tax", "Nuclei_near", "Nuclei_far"]
_RELATED_SQL = f"{LINES}, e AS (SELECT *, Cells_price * 1.3 + Nuclei_discount * 10000 AS Nuclei_near, -Cells_price + Cytoplasm_tax AS Nuclei_far FROM lines)"
_PAIRS = [(a, b) for i, a in enumerate(_RELATED) for b in _RELATED[:i]]


def _pairs(spark, df, method):
    return spark.createDataFrame([(a, b, round(r, 5) + 0.0) for a, b, r in pairwise(df, _RELATED, method)[1]], "pair_a string, pair_b string, correlation double")


@query("correlation_pearson", f"WITH {_RELATED_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS pair_a, '{b}' AS pair_b, round(corr({a}, {b}), 5) + 0.0 AS correlation FROM e" for a, b in _PAIRS))
def _(spark, d):
    return _pairs(spark, _related(spark, d), "pearson")


_PART = ["p_partkey", "p_size", "p_retailprice"]


@query("correlation_kendall", "WITH p AS (SELECT row_number() OVER () AS r, * FROM part) " + " UNION ALL ".join(f"SELECT '{a}' AS pair_a, '{b}' AS pair_b, round(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / (sqrt(count(*) FILTER (x.{a} <> y.{a})) * sqrt(count(*) FILTER (x.{b} <> y.{b}))), 5) + 0.0 AS correlation FROM p x JOIN p y ON x.r < y.r" for i, a in enumerate(_PART) for b in _PART[:i]))
def _(spark, d):
    pairs = pairwise(read(spark, d, "part"), _PART, "kendall")[1]
    return spark.createDataFrame([(a, b, round(r, 5) + 0.0) for a, b, r in pairs], "pair_a string, pair_b string, correlation double")


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _RELATED)


@query("correlation_spearman", f"WITH {_RELATED_SQL}, k AS (SELECT {_RANKS} FROM e) " + " UNION ALL ".join(f"SELECT '{a}' AS pair_a, '{b}' AS pair_b, round(corr({a}, {b}), 5) + 0.0 AS correlation FROM k" for a, b in _PAIRS))
def _(spark, d):
    return _pairs(spark, _related(spark, d), "spearman")


@query("select_correlation", f"""WITH {_RELATED_SQL}, p AS ({" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM e" for i, a in enumerate(_RELATED) for j, b in enumerate(_RELATED))}),
t AS (SELECT a, i, sum(abs(r)) AS s FROM p GROUP BY a, i), o AS (SELECT a, row_number() OVER (ORDER BY round(s, 12), i) AS place FROM t),
x AS (SELECT CASE WHEN u.place > v.place THEN p.a ELSE p.b END AS f FROM p JOIN o u ON p.a = u.a JOIN o v ON p.b = v.a WHERE p.i > p.j AND p.r > 0.9)
SELECT a AS feature, a IN (SELECT f FROM x) AS excluded FROM o""")
def _(spark, d):
    return listing(spark, _RELATED, correlation_threshold(_related(spark, d), threshold=0.9))


@query("feature_select", f"WITH {LINES} SELECT Metadata_order, Metadata_line, Metadata_flag, Metadata_status, Cells_quantity, Cells_price FROM lines")
def _(spark, d):
    df = lines(spark, d).withColumn("Nuclei_Granularity_14_DNA", F.col("Cells_quantity"))
    return feature_select(df, operation=["variance_threshold", "blocklist", "noise_removal"], min_variance=0.01, noise_removal_perturb_groups="Metadata_flag", noise_removal_stdev_cutoff=1e6)


# consensus

for _how, _sql in (("median", "median"), ("mean", "avg")):
    query(f"consensus_{_how}", f"WITH {LINES} SELECT Metadata_status, {_each('round(' + _sql + '({c}), 4)')} FROM lines GROUP BY ALL")(lambda spark, d, how=_how: rounded(consensus(lines(spark, d), ["Metadata_status"], operation=how)))


@query("consensus_modz", f"""WITH {LINES}, n AS (SELECT row_number() OVER () AS r, * FROM lines),
v AS ({" UNION ALL ".join(f"SELECT Metadata_order AS g, r, {i} AS i, {c} AS x FROM n" for i, c in enumerate(FEATURES))}),
c AS (SELECT a.g, a.r AS a, b.r AS b, corr(a.x, b.x) AS r FROM v a JOIN v b ON a.g = b.g AND a.i = b.i AND a.r <> b.r GROUP BY ALL),
w AS (SELECT g, a, greatest(avg(greatest(r, 0)), 0.01) AS w FROM c GROUP BY ALL), k AS (SELECT g, a, round_even(w / sum(w) OVER (PARTITION BY g), 4) AS w FROM w)
SELECT Metadata_order, {_each("round(sum({c} * coalesce(w, 1)), 6) + 0.0")} FROM n LEFT JOIN k ON n.r = k.a GROUP BY Metadata_order""")
def _(spark, d):
    """Orders are the replicate groups, up to seven lines each."""
    return rounded(consensus(lines(spark, d), ["Metadata_order"], operation="modz", modz_args={"method": "pearson"}), 6)


#: Weights of the replicates of a label: each one's mean correlation with the others, negative ones as 0.
_MODZ_SQL = """
WITH v AS (SELECT label AS g, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
k AS ({values}), c AS (SELECT a.g, a.vec_id AS a, b.vec_id AS b, corr(a.x, b.x) AS r FROM k a JOIN k b ON a.g = b.g AND a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
w AS (SELECT g, a, greatest(avg(greatest(r, 0)), 0.01) AS w FROM c GROUP BY ALL), n AS (SELECT g, a, round_even(w / sum(w) OVER (PARTITION BY g), 4) AS w FROM w)
SELECT v.g AS Metadata_label, {columns} FROM v JOIN n ON v.vec_id = n.a GROUP BY v.g
"""
_MODZ_COLUMNS = ", ".join(f"round(sum(CASE WHEN i = {k + 1} THEN x * w END), 4) + 0.0 AS Cells_{k}" for k in range(64))
_MODZ_VALUES = {"pearson": "SELECT * FROM v", "spearman": "SELECT g, vec_id, i, rank() OVER (PARTITION BY vec_id ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2.0 AS x FROM v"}

for _how in _MODZ_VALUES:

    @query(f"consensus_modz_{_how}", _MODZ_SQL.format(values=_MODZ_VALUES[_how], columns=_MODZ_COLUMNS))
    def _(spark, d, how=_how):
        """Groups are labels, over the whole table of vectors."""
        df = read(spark, d, "embeddings").select(F.col("label").alias("Metadata_label"), *[F.col("embedding")[i].cast("double").alias(f"Cells_{i}") for i in range(64)])
        return rounded(consensus(df, "Metadata_label", operation="modz", modz_args={"method": how}))


# single cells: orders are images, lines are objects


def cells(spark: SparkSession, d: str) -> SingleCells:
    line, order = read(spark, d, "lineitem"), read(spark, d, "orders")
    keys = [F.col("l_orderkey").alias("ImageNumber"), F.lit(1).alias("TableNumber")]
    number = F.col("l_linenumber").alias("ObjectNumber")
    one = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"), F.max("l_tax").alias("l_tax"))
    return SingleCells(
        {
            "image": order.select(F.col("o_orderkey").alias("ImageNumber"), F.lit(1).alias("TableNumber"), F.col("o_orderstatus").alias("Metadata_Plate"), F.col("o_orderpriority").alias("Metadata_Well"), (F.col("o_orderkey") % 9).alias("Metadata_Site"), F.col("o_totalprice").alias("Granularity_1")),
            "cells": one.select(*keys, number, F.col("l_quantity").alias("Cells_quantity")),
            "cytoplasm": one.select(*keys, number, F.col("l_linenumber").alias("Cytoplasm_Parent_Cells"), F.col("l_linenumber").alias("Cytoplasm_Parent_Nuclei"), F.col("l_extendedprice").alias("Cytoplasm_price")),
            "nuclei": one.select(*keys, number, F.col("l_tax").alias("Nuclei_tax")),
        },
        aggregation_operation="mean",
        subsampling_random_state=7,
    )


_ONE = "one AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_extendedprice) AS p, max(l_tax) AS t FROM lineitem GROUP BY ALL)"


@query("single_cells_merge", f"WITH {_ONE} SELECT 1 AS Metadata_TableNumber, l_orderkey AS Metadata_ImageNumber, l_linenumber AS Metadata_ObjectNumber_cytoplasm, l_linenumber AS Metadata_Cytoplasm_Parent_Cells, l_linenumber AS Metadata_Cytoplasm_Parent_Nuclei, l_linenumber AS Metadata_ObjectNumber_cells, l_linenumber AS Metadata_ObjectNumber_nuclei, o_orderkey % 9 AS Metadata_Site, o_orderstatus AS Metadata_Plate, o_orderpriority AS Metadata_Well, q AS Cells_quantity, p AS Cytoplasm_price, t AS Nuclei_tax FROM one LEFT JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    return cells(spark, d).merge_single_cells()


@query("single_cells_aggregate", f"WITH {_ONE}, j AS (SELECT * FROM one JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY ALL) SELECT j.o_orderstatus AS Metadata_Plate, j.o_orderpriority AS Metadata_Well, count(l_linenumber) AS Metadata_Object_Count, max(s.n) AS Metadata_Site_Count, round(avg(q), 4) AS Cells_quantity, round(avg(p), 4) AS Cytoplasm_price, round(avg(t), 4) AS Nuclei_tax FROM j JOIN s ON j.o_orderstatus = s.o_orderstatus AND j.o_orderpriority = s.o_orderpriority GROUP BY ALL")
def _(spark, d):
    return rounded(cells(spark, d).aggregate_profiles())


@query("single_cells_count", "SELECT o_orderstatus AS Metadata_Plate, o_orderpriority AS Metadata_Well, count(*) AS cell_count FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(spark, d):
    return cells(spark, d).count_cells()


@query("image_features", "SELECT o_orderstatus AS Metadata_Plate, count(*) AS Metadata_Site_Count, CAST(sum(o_custkey) AS BIGINT) AS Metadata_Count_Cells, round(median(o_totalprice), 4) AS Image_Granularity_1 FROM orders GROUP BY ALL")
def _(spark, d):
    image = read(spark, d, "orders").selectExpr("o_orderstatus AS Metadata_Plate", "o_orderkey AS Metadata_Site", "o_custkey AS Count_Cells", "o_totalprice AS Granularity_1")
    extracted = extract_image_features(["Count", "Granularity"], image, ["Metadata_Site"], ["Metadata_Plate"])
    return rounded(aggregate_image_features(count_fields(image, ["Metadata_Plate"]), extracted, ["Count", "Granularity"], ["Metadata_Site"], ["Metadata_Plate"]))


@query("sample_fraction", "SELECT user_id AS Metadata_user, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS n FROM events GROUP BY ALL HAVING round_even(count(*) * 0.5, 0) > 0")
def _(spark, d):
    df = read(spark, d, "events").select(F.col("user_id").alias("Metadata_user"), "event_id")
    return sample_fraction(df, ["Metadata_user"], 0.5, 3).groupBy("Metadata_user").agg(F.count("*").alias("n"))


@query("sample_number", "SELECT event_type AS Metadata_type, 25 AS n FROM events GROUP BY ALL")
def _(spark, d):
    df = read(spark, d, "events").select(F.col("event_type").alias("Metadata_type"), "event_id")
    return sample_number(df, ["Metadata_type"], 25, 3).groupBy("Metadata_type").agg(F.count("*").alias("n"))


@query("nested_centres", "SELECT l_orderkey, string_agg(printf('%d:%.2f:%.2f', l_linenumber, l_quantity, l_extendedprice), ';' ORDER BY l_linenumber, l_quantity, l_extendedprice) AS centres FROM lineitem GROUP BY ALL")
def _(spark, d):
    nested = nested_centres(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", "l_extendedprice")
    return nested.select("l_orderkey", F.array_join(F.transform("CellCenters", lambda c: F.format_string("%d:%.2f:%.2f", c["l_linenumber"], c["l_quantity"], c["l_extendedprice"])), ";").alias("centres"))


@query("union_chunks", f"WITH {LINES} SELECT Metadata_status, {_each('round(avg({c}), 4)')} FROM lines GROUP BY ALL")
def _(spark, d):
    df = lines(spark, d)
    return rounded(aggregate(df.filter("Metadata_order % 2 = 0").unionByName(df.filter("Metadata_order % 2 = 1")), strata=["Metadata_status"], operation="mean"))
