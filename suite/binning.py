"""Binning rules over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions import codes
from sparktab.operators import binning as B
from suite.common import PHOTO, photo, query, table


def _cont(col: str, q: int, inner: bool = False) -> str:
    steps = range(1, q) if inner else range(q + 1)
    return f"quantile_cont({col}, [{', '.join(f'{i}e0 / {q}' for i in steps)}])"


def _below(edges: str, x: str, op: str) -> str:
    return f"CAST(len(list_filter({edges}, lambda e: e {op} {x})) AS INTEGER)"


_TRIM = "list_sort(list_distinct({q}))[2:-2]"


@query(
    "b1_equal_width_bin",
    f"""WITH {PHOTO}, e AS (SELECT min(alpha) AS la, max(alpha) AS ha, min(delta) AS ld, max(delta) AS hd
      FROM photo WHERE source = 'train'),
    b AS (SELECT id,
      CASE WHEN alpha BETWEEN la AND ha THEN {' + '.join(f'CAST(la + (ha - la) * {i} / 20 < alpha AS INTEGER)' for i in range(1, 20))} END AS a,
      CASE WHEN delta BETWEEN ld AND hd THEN {' + '.join(f'CAST(ld + (hd - ld) * {i} / 20 < delta AS INTEGER)' for i in range(1, 20))} END AS d
      FROM photo, e)
    SELECT id, coalesce(a, -1) AS alpha_bin, coalesce(d, -1) AS delta_bin, coalesce(a * 20 + d, -1) AS cell FROM b""",
)
def b1(spark, sf):
    ph = photo(spark, sf).select("id", "alpha", "delta", "source")
    fitted = B.EqualWidthBinner(["alpha", "delta"], 20).fit(ph.where("source = 'train'"))
    out = fitted.cell(fitted.transform(ph), "alpha", "delta", "cell")
    return out.drop("alpha", "delta", "source").fillna(-1)


@query(
    "b2_quantile_bin_right",
    f"""WITH q AS (SELECT {_TRIM.format(q=_cont('l_quantity', 10))} AS e,
      {_TRIM.format(q=_cont('l_discount', 10))} AS d FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_below('e', 'l_quantity', '<')} AS l_quantity_q10,
      {_below('d', 'l_discount', '<')} AS l_discount_q10 FROM lineitem, q""",
)
def b2(spark, sf):
    li = table(spark, sf, "lineitem")
    fitted = B.QuantileBinner(["l_quantity", "l_discount"], 10, "right", missing=None).fit(li)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return fitted.transform(li).select(*keys, "l_quantity_q10", "l_discount_q10")


@query(
    "b3_quantile_bin_left",
    f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders),
    q AS (SELECT {_TRIM.format(q=_cont('v', 64))} AS e, list_distinct({_cont('v', 500, True)}) AS f FROM x)
    SELECT o_orderkey, coalesce(CASE WHEN v IS NOT NULL THEN {_below('e', 'v', '<=')} END, -1) AS v_q64,
      coalesce(CASE WHEN v IS NOT NULL THEN {_below('f', 'v', '<=')} END, -1) AS v_q500 FROM x, q""",
)
def b3(spark, sf):
    k = F.col("o_orderkey") % 11
    v = F.when(k == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    df = table(spark, sf, "orders").select("o_orderkey", v.alias("v"))
    out = B.QuantileBinner(["v"], 64, "left", "trim").fit(df).transform(df)
    return B.QuantileBinner(["v"], 500, "left", "interior").fit(df).transform(out).drop("v")


@query(
    "b4_quantile_bin_reference",
    f"""WITH {PHOTO}, q AS (SELECT list_sort(list_distinct({_cont('redshift', 32)})) AS a FROM photo WHERE source <> 'aux')
    SELECT id, CASE WHEN redshift < a[1] OR redshift > a[-1] THEN -1 ELSE {_below('a[2:-2]', 'redshift', '<')} END AS redshift_q32
    FROM photo, q""",
)
def b4(spark, sf):
    ph = photo(spark, sf).select("id", "redshift", "source")
    fitted = B.QuantileBinner(["redshift"], 32, "right", "trim", -1, outside=-1)
    return fitted.fit(ph.where("source <> 'aux'")).transform(ph).select("id", "redshift_q32")


@query(
    "b5_rank_bin",
    """SELECT event_id, CAST(ntile(64) OVER (ORDER BY value, md5('0:' || event_id), event_id) - 1 AS INTEGER) AS value_bin
    FROM events""",
)
def b5(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return B.rank_bin(ev, "value", 64, "event_id", "value_bin", rows_per_bucket=1000).drop("value")


def _fold_case(q: int) -> str:
    return f"{_below('e' + str(q), 'x.value', '<=')} + 1 AS value_q{q}"


@query(
    "b6_fold_quantile_bin",
    f"""WITH x AS (SELECT event_id, value, CAST(event_id % 5 AS INTEGER) AS fold FROM events),
    q AS (SELECT f.fold, list_distinct({_cont('value', 16, True)}) AS e16, list_distinct({_cont('value', 32, True)}) AS e32
      FROM x JOIN (SELECT DISTINCT fold FROM x) f ON x.fold <> f.fold GROUP BY f.fold)
    SELECT event_id, x.fold, {_fold_case(16)}, {_fold_case(32)} FROM x JOIN q ON x.fold = q.fold""",
)
def b6(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "value", (F.col("event_id") % 5).cast("int").alias("fold")
    )
    return B.fold_quantile_codes(ev, "value", [16, 32], 5).drop("value")


@query(
    "b7_shared_rank_edges",
    f"""WITH {PHOTO}, q AS (SELECT list_distinct({_cont('u', 24, True)}) AS e FROM photo)
    SELECT id, {_below('e', 'u', '<=')} AS u_q24 FROM photo, q WHERE source = 'test'""",
)
def b7(spark, sf):
    ph = photo(spark, sf).select("id", "u", "source")
    frames = [ph.where(F.col("source") == s) for s in ("train", "test", "aux")]
    return B.shared_rank_edges(frames, "u", 24).transform(frames[1]).select("id", "u_q24")


@query(
    "b8_fit_transform_deciles",
    f"""WITH {PHOTO}, q AS (SELECT list_distinct({_cont('redshift', 10, True)}) AS e FROM photo WHERE source = 'train')
    SELECT id, {_below('e', 'redshift', '<=')} AS redshift_q10 FROM photo, q WHERE source = 'test'""",
)
def b8(spark, sf):
    """The edges travel as a table: saved state and reloaded state bin alike."""
    ph = photo(spark, sf).select("id", "redshift", "source")
    fitted = B.QuantileBinner(["redshift"], 10, "left", "interior").fit(ph.where("source = 'train'"))
    again = B.QuantileBinner(["redshift"], 10, "left", "interior").load(fitted.state(spark))
    return again.transform(ph.where("source = 'test'")).select("id", "redshift_q10")


@query(
    "b9_fixed_bin",
    f"""WITH {PHOTO} SELECT id,
      CASE WHEN r - g <= -1 THEN 'M' WHEN r - g <= -5e-1 THEN 'G/K' WHEN r - g <= 0 THEN 'A/F' ELSE 'O/B' END AS spectral_type,
      CASE WHEN u - r <= 22e-1 THEN 'Blue_Cloud' ELSE 'Red_Sequence' END AS galaxy_population,
      CASE WHEN redshift < 0 THEN 0 WHEN redshift < 5e-1 THEN 1 WHEN redshift < 1 THEN 2 ELSE 3 END AS redshift_code
    FROM photo""",
)
def b9(spark, sf):
    ph = codes.rebuild_sky_categories(photo(spark, sf))
    code = codes.fixed_bin(F.col("redshift"), [0.0, 0.5, 1.0], closed="left")
    return ph.select("id", "spectral_type", "galaxy_population", code.alias("redshift_code"))


@query(
    "b10_digit_codes",
    f"""WITH {PHOTO} SELECT id, CAST(floor(delta) AS INTEGER) AS floor_cat,
      CAST(round_even(delta * 10e0, 0) AS INTEGER) AS round1_cat,
      CAST(floor(abs(delta)) AS BIGINT) % 10 AS mod10_cat, CAST(floor(abs(alpha)) AS BIGINT) % 100 AS mod100_cat,
      CAST(floor((abs(u) - floor(abs(u))) * 20) AS INTEGER) AS frac20_cat,
      CAST(floor((abs(u) - floor(abs(u))) * 1000) AS INTEGER) AS decimal1000_cat FROM photo""",
)
def b10(spark, sf):
    c = F.col
    return photo(spark, sf).select(
        "id",
        codes.floor_code(c("delta")).alias("floor_cat"),
        codes.round_code(c("delta"), 1).alias("round1_cat"),
        codes.mod_code(c("delta"), 10).alias("mod10_cat"),
        codes.mod_code(c("alpha"), 100).alias("mod100_cat"),
        codes.frac_code(c("u"), 20).alias("frac20_cat"),
        codes.frac_code(c("u"), 1000).alias("decimal1000_cat"),
    )


@query(
    "b11_scaled_floor_key",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '-2147483648'
      ELSE CAST(CAST(floor(o_totalprice * 1e-2) AS BIGINT) AS VARCHAR) END AS price_key FROM orders""",
)
def b11(spark, sf):
    v = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    return table(spark, sf, "orders").select(
        "o_orderkey", codes.scaled_floor_key(v, 0.01).alias("price_key")
    )
