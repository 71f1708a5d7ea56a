"""Group statistics, scalers, profiles and text/date summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import groupstats as G
from sparktab.operators import terms
from sparktab.operators.binning import QuantileBinner
from suite.common import BANDS, PHOTO, photo, query, r, rounded, rs, table
from suite.binning import _below, _cont, _TRIM

_GC = ["u", "redshift"]


def _gs(prefix: str) -> list[str]:
    out = [f"{prefix}.n AS {prefix}_count"]
    for c in _GC:
        out += [r(f"{prefix}.m_{c}", f"{prefix}_{c}_mean"), r(f"coalesce({prefix}.s_{c}, 0e0)", f"{prefix}_{c}_std"),
                r(f"x.{c} - {prefix}.m_{c}", f"{prefix}_{c}_dev")]
    return out


_GAGG = "count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _GC)


@query(
    "e7_group_stats",
    f"""WITH {PHOTO}, q AS (SELECT {_TRIM.format(q=_cont('redshift', 16))} AS e FROM photo),
    x AS (SELECT id, u, redshift, coalesce(spectral_type, '__NA__') AS spec, {_below('e', 'redshift', '<=')} AS rz FROM photo, q),
    g_spec AS (SELECT spec, {_GAGG} FROM x GROUP BY spec), g_rz AS (SELECT rz, {_GAGG} FROM x GROUP BY rz)
    SELECT id, {', '.join(_gs('g_spec') + _gs('g_rz'))} FROM x JOIN g_spec USING (spec) JOIN g_rz USING (rz)""",
)
def e7(spark, sf):
    ph = photo(spark, sf).select("id", *_GC, F.coalesce("spectral_type", F.lit("__NA__")).alias("spec"))
    binner = QuantileBinner(["redshift"], 16).fit(ph)
    x = ph.withColumn("rz", binner.code("redshift"))
    out = G.group_stats(x, {"g_spec": "spec", "g_rz": "rz"}, _GC)
    return rounded(out.drop("spec", "rz", *_GC))


_PC = ["u", "g", "r", "redshift"]


@query(
    "e8_class_prototypes",
    f"""WITH {PHOTO}, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _PC)} FROM photo),
    z AS (SELECT id, y, source, {', '.join(f'(({c} - m_{c}) / s_{c}) AS z_{c}' for c in _PC)} FROM photo, st),
    p AS (SELECT y AS k, {', '.join(f'avg(z_{c}) AS c_{c}, stddev_pop(z_{c}) + 5e-2 AS w_{c}' for c in _PC)} FROM z WHERE source = 'aux' GROUP BY y),
    d AS (SELECT id, k, sqrt(({' + '.join(f'pow(z_{c} - c_{c}, 2)' for c in _PC)}) / 4) AS e,
      sqrt(({' + '.join(f'pow((z_{c} - c_{c}) / w_{c}, 2)' for c in _PC)}) / 4) AS g,
      ({' + '.join(f'abs((z_{c} - c_{c}) / w_{c})' for c in _PC)}) / 4 AS a FROM z, p WHERE source <> 'aux'),
    w AS (SELECT id, {', '.join(f'max(CASE WHEN k = {k} THEN e END) AS e{k}, max(CASE WHEN k = {k} THEN g END) AS g{k}, max(CASE WHEN k = {k} THEN a END) AS a{k}' for k in range(3))},
      list_sort(list(e)) AS le, list_sort(list(g)) AS lg FROM d GROUP BY id)
    SELECT id, {', '.join(r(f'e{k}', f'proto_euclid_{k}') + ', ' + r(f'g{k}', f'proto_diag_{k}') + ', ' + r(f'a{k}', f'proto_absmean_{k}') for k in range(3))},
      {r('le[1]', 'proto_euclid_min')}, {r('le[2] - le[1]', 'proto_euclid_gap12')}, {r('lg[1]', 'proto_diag_min')},
      {r('lg[2] - lg[1]', 'proto_diag_gap12')}, {r('e2 - e1', 'proto_star_minus_qso')}, {r('e0 - e1', 'proto_galaxy_minus_qso')} FROM w""",
)
def e8(spark, sf):
    ph = photo(spark, sf).select("id", "y", "source", *_PC)
    out = G.class_prototypes(
        ph.where("source = 'aux'"), ph.where("source <> 'aux'"), _PC, "y", 3,
        {"proto_star_minus_qso": (2, 1), "proto_galaxy_minus_qso": (0, 1)},
    )
    return rounded(out.drop("y", "source", *_PC))


@query(
    "e9_standard_scale",
    f"""WITH {PHOTO}, s AS (SELECT {', '.join(f'avg({b}) AS m_{b}, stddev_pop({b}) AS s_{b}' for b in BANDS)} FROM photo WHERE source = 'train')
    SELECT id, {', '.join(r(f'({b} - m_{b}) / s_{b}', b) for b in BANDS)} FROM photo, s""",
)
def e9(spark, sf):
    ph = photo(spark, sf).select("id", "source", *BANDS)
    return rounded(G.StandardScale(BANDS).fit(ph.where("source = 'train'")).transform(ph).drop("source"))


_RQ = ", ".join(f"quantile_cont({b}, [0e0, 25e-2, 5e-1, 75e-2, 1e0]) AS q_{b}" for b in ("u", "g"))


def _rob(b: str) -> str:
    x = f"(({b} - q_{b}[3]) / (q_{b}[4] - q_{b}[2]))"
    return f"({x} / sqrt(1 + pow({x} / 3, 2)))"


@query(
    "e10_robust_scale",
    f"""WITH {PHOTO}, s AS (SELECT {_RQ} FROM photo WHERE source = 'train'),
    t AS (SELECT id, {_rob('u')} AS u, {_rob('g')} AS g FROM photo, s)
    SELECT id, {r('u', 'u_rs')}, {r('g', 'g_rs')}, {r('u / sqrt(u * u + g * g)', 'u_rn')}, {r('g / sqrt(u * u + g * g)', 'g_rn')} FROM t""",
)
def e10(spark, sf):
    ph = photo(spark, sf).select("id", "source", "u", "g")
    train = ph.where("source = 'train'")
    out = G.RobustScale(["u", "g"]).fit(train).transform(ph)
    out = G.RobustScale(["u", "g"], row_norm=True).fit(train).transform(out, "_rn")
    return rounded(out.drop("source", "u", "g"))


@query(
    "e12_impute",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS v,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS s FROM orders),
    m AS (SELECT avg(v) AS a, median(v) AS b FROM x),
    t AS (SELECT s FROM x WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
    SELECT o_orderkey, """ + ", ".join([r("coalesce(v, a)", "by_mean"), r("coalesce(v, b)", "by_median")])
    + ", coalesce(v, -1e0) AS by_constant, coalesce(x.s, t.s) AS by_mode, coalesce(x.s, 'MISSING') AS by_token FROM x, m, t",
)
def e12(spark, sf):
    k = F.col("o_orderkey")
    v, s = F.when(k % 6 != 0, F.col("o_totalprice")), F.when(k % 5 != 0, F.col("o_orderpriority"))
    df = table(spark, sf, "orders").select(
        "o_orderkey", v.alias("by_mean"), v.alias("by_median"), v.alias("by_constant"),
        s.alias("by_mode"), s.alias("by_token"),
    )
    for col, how, value in [("by_mean", "mean", None), ("by_median", "median", None), ("by_constant", "constant", -1.0),
                            ("by_mode", "mode", None), ("by_token", "constant", "MISSING")]:
        df = G.Impute([col], how, value).fit(df).transform(df)
    return rounded(df)


@query(
    "e13_min_max_log",
    """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
    SELECT c_custkey, """ + r("(c_acctbal - lo) / (hi - lo)", "c_acctbal_mm") + ", "
    + r("ln(1 + greatest(c_acctbal, 0e0))", "c_acctbal_ln") + " FROM customer, s",
)
def e13(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = G.log_transform(G.MinMaxScale(["c_acctbal"]).fit(c).transform(c), ["c_acctbal"])
    return rounded(out.drop("c_acctbal"))


@query(
    "e14_value_shares",
    f"SELECT l_returnflag, count(*) AS n, {r('count(*) / (SELECT count(*) FROM lineitem)', 'share')} FROM lineitem GROUP BY 1",
)
def e14(spark, sf):
    return rounded(G.value_shares(table(spark, sf, "lineitem"), "l_returnflag"))


_PN, _PO = ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]


@query(
    "e15_profile",
    " UNION ALL ".join(
        [f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls, count(*) FILTER ({c} = -9999) AS sentinels,
        {r(f'min({c})', 'min')}, {r(f'avg({c})', 'mean', 4)}, {r(f'max({c})', 'max')}, {r(f'stddev_samp({c})', 'std', 4)},
        {r(f'quantile_cont({c}, 0.25)', 'q25', 4)}, {r(f'quantile_cont({c}, 0.5)', 'q50', 4)}, {r(f'quantile_cont({c}, 0.75)', 'q75', 4)}, count(DISTINCT {c}) AS n_distinct FROM lineitem""" for c in _PN]
        + [f"""SELECT '{c}', count(*), count(*) - count({c}), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}) FROM lineitem""" for c in _PO]),
)
def e15(spark, sf):
    out = G.profile(table(spark, sf, "lineitem"), _PN, _PO)
    short = {c: F.floor(F.col(c) * 1e4 + 0.5) / 1e4 for c in ("mean", "std", "q25", "q50", "q75")}
    return rounded(out.withColumns(short))


@query(
    "e15_duplicates_and_means",
    f"""SELECT 'dup' AS kind, l_orderkey AS k, l_linenumber AS j, count(*) AS n, CAST(NULL AS DOUBLE) AS m FROM lineitem
      GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'class', 0, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, count(*), {r('avg(l_extendedprice)', 'm', 4)} FROM lineitem GROUP BY 3""",
)
def e15_dup(spark, sf):
    li = table(spark, sf, "lineitem")
    dup = G.duplicate_rows(li, ["l_orderkey", "l_linenumber"]).select(
        F.lit("dup").alias("kind"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"),
        F.col("copies").alias("n"), F.lit(None).cast("double").alias("m"))
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    means = G.class_means(li.withColumn("j", code), "j", ["l_extendedprice"]).select(
        F.lit("class").alias("kind"), F.lit(0).cast("long").alias("k"), "j", "n",
        F.col("mean_l_extendedprice").alias("m"))
    return rounded(dup.unionByName(means), 4)


@query(
    "e16_mean_importance",
    f"""WITH f AS (SELECT p_name AS feature, p_size % 5 AS fold, sum(p_retailprice) AS gain FROM part GROUP BY ALL)
    SELECT feature, {r('avg(gain)', 'mean_gain', 4)} FROM f GROUP BY feature ORDER BY avg(gain) DESC, feature LIMIT 20""",
)
def e16(spark, sf):
    part = table(spark, sf, "part")
    gains = part.groupBy(F.col("p_name").alias("feature"), (F.col("p_size") % 5).alias("fold")).agg(
        F.sum("p_retailprice").alias("gain"))
    return rounded(G.mean_importance(gains, 20), 4)


_CC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "e17_column_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr')} FROM lineitem"
        for i, a in enumerate(_CC) for b in _CC[i + 1:]),
)
def e17(spark, sf):
    return rounded(G.column_correlation(table(spark, sf, "lineitem"), _CC))


# Columns with gaps, of very different sizes, and one without spread.
_GAPS = {
    "quantity": "l_quantity", "price": "nullif(l_extendedprice, 0)", "discount": "nullif(l_discount, 0)",
    "tax": "nullif(l_tax, 0.02)", "line": "nullif(l_linenumber, 3)", "part": "l_partkey + 1e9", "supplier": "l_suppkey",
    "order_": "CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey END", "net": "l_extendedprice * (1 - l_discount)", "one": "1e0",
}


@query(
    "e17_correlation_with_gaps",
    f"WITH x AS (SELECT {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _GAPS.items())} FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, " + ("CAST(CASE WHEN count(*) < 0 THEN 1 END AS DOUBLE) AS corr" if b == "one" else r(f"corr({a}, {b})", "corr")) + " FROM x"
        for i, a in enumerate(_GAPS) for b in list(_GAPS)[i + 1:]),
)
def e17_gaps(spark, sf):
    """45 pairs from one scan."""
    li = table(spark, sf, "lineitem").select(*[F.expr(v).alias(k) for k, v in _GAPS.items()])
    return rounded(G.column_correlation(li, list(_GAPS)))


@query(
    "e18_date_parts",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day,
      CAST(isodow(ts) - 1 AS INTEGER) AS ts_weekday, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(isodow(ts) >= 6 AS INTEGER) AS ts_is_weekend,
      CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS ts_days FROM events""",
)
def e18(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return G.date_parts(ev, "ts", "2020-01-01").drop("ts")


@query(
    "e19_text_stats",
    r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS text_chars,
      CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS INTEGER) AS text_words,
      CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS text_has_digit,
      CAST(regexp_matches(text, 'https?://') AS INTEGER) AS text_has_url FROM documents""",
)
def e19(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return G.text_stats(docs, "text", {"has_digit": "[0-9]", "has_url": "https?://"}).drop("text")


@query(
    "e20_term_weights",
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT doc_id, term, tf, df, """ + r("tf * (ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + df)) + 1e0)", "weight")
    + " FROM tf JOIN d USING (term)",
)
def e20(spark, sf):
    return rounded(terms.term_weights(table(spark, sf, "documents"), "doc_id", "text", 1))


@query(
    "e20_vocabulary",
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    d AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term),
    k AS (SELECT * FROM d ORDER BY n DESC, md5('0:' || term), term LIMIT 100)
    SELECT term, CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS id, CAST(n AS BIGINT) AS n, df, """
    + r("ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + df)) + 1e0", "idf") + " FROM k",
)
def e20_vocabulary(spark, sf):
    """The 100 most frequent terms: a cut, so that terms tie there."""
    docs = table(spark, sf, "documents")
    return rounded(terms.vocabulary(terms.term_counts(docs, "doc_id", "text"), docs.count(), 100))


@query("e20_tfidf_components")
def e20_pca(spark, sf):
    return rounded(terms.tfidf_components(table(spark, sf, "documents"), "doc_id", "text", 4), 4)
