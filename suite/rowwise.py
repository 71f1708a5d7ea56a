"""Row-wise features and recipes over the derived survey table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sparktab.functions import rowwise as R
from sparktab.operators.joins import stack_sources
from sparktab.plans import recipes
from suite.common import BANDS, PHOTO, RAW, photo, query, r, rounded, rs, table

PAIRS = list(combinations(BANDS, 2))


def _photo(cols: str, where: str = "") -> str:
    return f"WITH {PHOTO} SELECT {cols} FROM photo {where}"


@query(
    "p1_pairwise_diff",
    _photo("id, " + ", ".join(
        f"{r(f'{a} - {b}', f'{a}_{b}')}, {r(f'abs({a} - {b})', f'abs_{a}_{b}')}" for a, b in PAIRS)),
)
def p1(spark, sf):
    df = R.pairwise_diff(photo(spark, sf).select("id", *BANDS), BANDS, absolute=True)
    return rounded(df.drop(*BANDS))


@query(
    "p2_second_order_diff",
    _photo(f"id, {r('(u - g) - (g - r)', 'ug_gr')}, {r('(g - r) - (r - i)', 'gr_ri')}, "
           f"{r('(r - i) - (i - z)', 'ri_iz')}"),
)
def p2(spark, sf):
    df = R.pairwise_diff(photo(spark, sf).select("id", *BANDS), BANDS)
    df = R.second_order_diff(
        df, [("ug_gr", "u_g", "g_r"), ("gr_ri", "g_r", "r_i"), ("ri_iz", "r_i", "i_z")]
    )
    return rounded(df.select("id", "ug_gr", "gr_ri", "ri_iz"))


@query(
    "p3_safe_ratio",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + r("l_extendedprice / (abs(l_discount) + 1e-6)", "abs_ratio", 2) + ", "
    + r("l_quantity / (l_tax + 1e-6)", "plain_ratio", 4) + ", "
    + r("l_quantity / CASE WHEN abs(l_discount - 5e-2) < 1e-6 THEN CASE WHEN l_discount - 5e-2 < 0 THEN -1e-6 ELSE 1e-6 END ELSE l_discount - 5e-2 END", "signed_ratio", 2)
    + " FROM lineitem",
)
def p3(spark, sf):
    li = table(spark, sf, "lineitem")
    c = F.col
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

    def at(e, digits):
        return F.floor(e * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)

    return li.select(
        *keys,
        at(R.ratio(c("l_extendedprice"), c("l_discount"), "abs"), 2).alias("abs_ratio"),
        at(R.ratio(c("l_quantity"), c("l_tax"), "plain"), 4).alias("plain_ratio"),
        at(R.ratio(c("l_quantity"), c("l_discount") - F.lit(0.05), "signed"), 2).alias("signed_ratio"),
    )


_LIST = "[u, g, r, i, z]"
_MEAN = "(u + g + r + i + z) / 5"
_SQ = " + ".join(f"pow({b} - {_MEAN}, 2)" for b in BANDS)
_GREAT, _LEAST = "greatest(u, g, r, i, z)", "least(u, g, r, i, z)"


def _place(target: str) -> str:
    return "CASE " + " ".join(f"WHEN {b} = {target} THEN {i}" for i, b in enumerate(BANDS)) + " END"


def _stats_sql(prefix: str, ddof: int) -> str:
    return ", ".join([
        r(_MEAN, f"{prefix}_mean"), r("u + g + r + i + z", f"{prefix}_sum"),
        r(f"sqrt(({_SQ}) / {5 - ddof})", f"{prefix}_std"),
        r(_LEAST, f"{prefix}_min"), r(_GREAT, f"{prefix}_max"),
        r(f"{_GREAT} - {_LEAST}", f"{prefix}_range"),
        r(f"list_sort({_LIST})[3]", f"{prefix}_median"),
        f"{_place(_LEAST)} AS {prefix}_argmin", f"{_place(_GREAT)} AS {prefix}_argmax",
    ])


@query("p4_row_stats", _photo(f"id, {_stats_sql('mag', 0)}, {_stats_sql('mag1', 1)}"))
def p4(spark, sf):
    df = photo(spark, sf).select("id", *BANDS)
    df = R.row_stats(R.row_stats(df, BANDS, "mag", 0), BANDS, "mag1", 1)
    return rounded(df.drop(*BANDS))


@query(
    "p5_row_slope_curvature",
    _photo("id, " + ", ".join([
        r("u * (-2e-1) + g * (-1e-1) + i * 1e-1 + z * 2e-1", "mag_slope"),
        r("((u - 2 * g + r) + (g - 2 * r + i) + (r - 2 * i + z)) / 3", "mag_curvature"),
        r("u - 2 * g + r", "curve_ugr"), r("r - 2 * i + z", "curve_riz")])),
)
def p5(spark, sf):
    df = R.row_slope_curvature(
        photo(spark, sf).select("id", *BANDS), BANDS, "mag",
        {"curve_ugr": ("u", "g", "r"), "curve_riz": ("r", "i", "z")},
    )
    return rounded(df.drop(*BANDS))


def _flux(b: str) -> str:
    return f"pow(10e0, -4e-1 * least(greatest({b}, -30e0), 30e0))"


@query(
    "p6_mag_to_flux",
    _photo("id, " + ", ".join(
        [r(f"greatest({', '.join(_flux(b) for b in BANDS)}) * 1e9", "flux_max"), r(f"({' + '.join(_flux(b) for b in BANDS)}) * 1e9", "flux_sum", 3)]
        + [r(f"{_flux(b)} * 1e9", f"flux_{b}") for b in BANDS]
        + [r(f"ln(1 + {_flux(b)}) * 1e9", f"log1p_flux_{b}", 1) for b in BANDS]
        + [r(f"{_flux(a)} / (abs({_flux(b)}) + 1e-12)", f"flux_ratio_{a}_{b}") for a, b in zip(BANDS, BANDS[1:])]
        + [r(f"exp(-921034e-6 * least(greatest({a} - {b}, -20e0), 20e0))", f"color_flux_{a}_{b}") for a, b in zip(BANDS, BANDS[1:])])),
)
def p6(spark, sf):
    df = R.mag_to_flux(photo(spark, sf).select("id", *BANDS), BANDS, stats=True).drop(*BANDS)
    df = df.drop("flux_mean", "flux_std", "flux_min", "flux_range", "flux_median", "flux_argmin", "flux_argmax")
    df = df.withColumns({f"flux_{b}": F.col(f"flux_{b}") * 1e9 for b in [*BANDS, "max"]})
    df = df.withColumn("flux_sum", F.floor(F.col("flux_sum") * 1e9 * 1e3 + 0.5) / 1e3)
    logs = [f"log1p_flux_{b}" for b in BANDS]
    df = df.withColumns({c: F.floor(F.col(c) * 1e9 * 10.0 + 0.5) / 10.0 for c in logs})
    return rounded(df)


@query(
    "p7_signed_transforms",
    _photo("id, " + ", ".join([
        r("abs(redshift)", "redshift_abs"), r("ln(1 + abs(redshift))", "redshift_log1p"),
        r("sqrt(abs(redshift))", "redshift_sqrt"), r("cbrt(redshift)", "redshift_cbrt"),
        r("redshift * redshift", "redshift_sq"),
        "CAST(redshift < 0 AS INTEGER) AS redshift_is_neg",
        r("1 / (abs(redshift) + 1e-6)", "redshift_inv", 3),
        "CAST(redshift < 5e-2 AS INTEGER) AS redshift_below_0",
        "CAST(redshift < 1e0 AS INTEGER) AS redshift_below_1"])),
)
def p7(spark, sf):
    df = R.signed_transforms(photo(spark, sf).select("id", "redshift"), "redshift", [0.05, 1.0])
    df = df.withColumn("redshift_inv", F.floor(F.col("redshift_inv") * 1e3 + 0.5) / 1e3)
    return rounded(df.drop("redshift"))


@query(
    "p8_interactions",
    f"""WITH {PHOTO}, s AS (SELECT coalesce(spectral_type, '__NA__') AS kind, count(*) / (SELECT count(*) FROM photo) AS share
      FROM photo GROUP BY 1)
    SELECT id, """ + ", ".join(
        [r(f"redshift * {b}", f"redshift_x_{b}") for b in BANDS]
        + [r(f"redshift / (abs({b}) + 1e-6)", f"redshift_over_{b}") for b in BANDS]
        + [r("share * coalesce(CASE WHEN redshift < 1 THEN 0 WHEN redshift < 2 THEN 1 END, -1)", "share_bin")])
    + " FROM photo JOIN s ON coalesce(spectral_type, '__NA__') = kind",
)
def p8(spark, sf):
    ph = photo(spark, sf)
    from sparktab.operators.categories import frequency_encode

    df = R.interactions(ph.select("id", "spectral_type", "redshift", *BANDS), "redshift", BANDS)
    df = frequency_encode(ph, df, "spectral_type", "share")
    df = df.withColumn("bin", F.when(F.col("redshift") < 1, 0).when(F.col("redshift") < 2, 1))
    df = R.share_times_bin(df, "share", "bin", "share_bin")
    return rounded(df.drop(*BANDS, "redshift", "spectral_type", "share", "bin"))


@query(
    "p9_sky_position",
    _photo("id, " + ", ".join([
        r("alpha * delta", "alpha_delta"), r("sin(radians(alpha))", "sin_alpha"),
        r("cos(radians(alpha))", "cos_alpha"), r("sin(radians(delta))", "sin_delta"),
        r("cos(radians(delta))", "cos_delta"),
        r("cos(radians(delta)) * cos(radians(alpha))", "sky_x"),
        r("cos(radians(delta)) * sin(radians(alpha))", "sky_y"),
        r("sin(radians(delta))", "sky_z")])),
)
def p9(spark, sf):
    df = R.sky_position(photo(spark, sf).select("id", "alpha", "delta"), "alpha", "delta")
    return rounded(df.drop("alpha", "delta"))


@query(
    "p10_polar_pair",
    _photo(f"id, {r('sqrt((u - g) * (u - g) + (g - r) * (g - r))', 'u_g_g_r_radius')}, "
           f"{r('atan2(u - g, (g - r) + 1e-6)', 'u_g_g_r_angle')}"),
)
def p10(spark, sf):
    df = R.pairwise_diff(photo(spark, sf).select("id", *BANDS), BANDS)
    out = R.polar_pair(df, "u_g", "g_r")
    return rounded(out.select("id", "u_g_g_r_radius", "u_g_g_r_angle"))


@query(
    "p11_linear_scores",
    _photo("id, " + ", ".join([
        r("(u - g) + (-6e-1)", "uvx_u_g_minus_0p6"),
        r("(u - g) + (g - r) * (-75e-2) + (-18e-2)", "uvx_plane"),
        r("(r - i) + (g - r) * (-25e-2) + (-18e-2)", "lrg_cperp"),
        r("(g - r) * 7e-1 + (r - i) * 12e-1 + (-216e-3)", "lrg_cparallel"),
        r("(u - g) + (g - r) * (-8e-1) + (r - i) * 35e-2 + (i - z) * (-2e-1)", "qso_color_plane"),
        r("(u - r) + (-22e-1)", "u_r_minus_2p2"),
        r("5 * log10(abs(redshift) + 1e-6)", "redshift_distmod_proxy"),
        r("u - 5 * log10(abs(redshift) + 1e-6)", "u_absmag_proxy")])),
)
def p11(spark, sf):
    df = R.pairwise_diff(photo(spark, sf).select("id", "redshift", *BANDS), BANDS)
    df = recipes.distance_proxies(R.linear_scores(df, recipes.COLOR_SCORES), ["u"])
    return rounded(df.select("id", *recipes.COLOR_SCORES, "redshift_distmod_proxy", "u_absmag_proxy"))


_Z = "least(greatest(redshift, -5e-2), 5e0)"


@query(
    "p12_soft_indicator",
    _photo("id, " + ", ".join([
        r(f"exp(-abs(({_Z} - 0e0) / 3e-3))", "star_z_peak"),
        r(f"exp(-(({_Z} - 1e-1) / 25e-2) * (({_Z} - 1e-1) / 25e-2))", "galaxy_z_low_peak"),
        r(f"1 / (1 + exp(-(({_Z} - 7e-1) / 25e-2)))", "qso_z_high_sigmoid"),
        r(f"1 / (1 + exp(-(({_Z} - 22e-1) / (1e0 / 3))))", "qso_z_veryhigh_sigmoid")])),
)
def p12(spark, sf):
    df = photo(spark, sf).select("id", "redshift")
    for name, kind, centre, scale in recipes.REDSHIFT_INDICATORS:
        df = R.soft_indicator(df, "redshift", kind, centre, scale, name, *recipes.REDSHIFT_RANGE)
    return rounded(df.drop("redshift"))


@query(
    "p13_log_shift",
    f"""WITH {PHOTO}, s AS (SELECT least(0e0, min(redshift)) AS s FROM photo WHERE source = 'train')
    SELECT id, {r("ln(1 + (redshift - s + 1e-4))", "redshift_log")} FROM photo, s WHERE source <> 'aux'""",
)
def p13(spark, sf):
    ph = photo(spark, sf).select("id", "redshift", "source")
    fitted = R.LogShift(["redshift"]).fit(ph.where("source = 'train'"))
    return rounded(fitted.transform(ph.where("source <> 'aux'")).select("id", "redshift_log"))


@query(
    "p14_clean_nonfinite",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN NULL ELSE o_totalprice END AS kept,
      CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN -1e0 ELSE o_totalprice END AS filled FROM orders""",
)
def p14(spark, sf):
    k = F.col("o_orderkey") % 7
    x = (
        F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf"))
        .otherwise(F.col("o_totalprice"))
    )
    df = table(spark, sf, "orders").select("o_orderkey", x.alias("kept"), x.alias("filled"))
    return R.clean_nonfinite(R.clean_nonfinite(df, ["kept"]), ["filled"], -1.0)


_EDGE_AB = """e AS (SELECT min(alpha) AS la, max(alpha) AS ha, min(delta) AS ld, max(delta) AS hd
      FROM photo WHERE source = 'train')"""


def _ew(c: str, lo: str, hi: str, n: int) -> str:
    terms = " + ".join(f"CAST({lo} + ({hi} - {lo}) * {i} / {n} < {c} AS INTEGER)" for i in range(1, n))
    return f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {terms} END"


_QZ = """q AS (SELECT list_distinct(quantile_cont(redshift, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1])) AS e
      FROM photo WHERE source = 'train')"""
_V3 = (
    [r(f"{a} - {b}", f"{a}_{b}") for a, b in zip(BANDS, BANDS[1:])]
    + [r("alpha * delta", "alpha_delta"), r("sin(radians(alpha))", "sin_alpha"),
       r("cos(radians(alpha))", "cos_alpha"), r("sin(radians(delta))", "sin_delta"),
       r("cos(radians(delta))", "cos_delta"),
       f"{_ew('alpha', 'la', 'ha', 20)} * 20 + {_ew('delta', 'ld', 'hd', 20)} AS alpha_delta_bin",
       "CAST(len(list_filter(e, lambda x: x < redshift)) AS INTEGER) AS redshift_bin",
       r("ln(1 + abs(redshift))", "log1p_abs_redshift"),
       r("redshift * (u - g)", "redshift_u_g"), r("redshift * (g - r)", "redshift_g_r"),
       r("(u - g) - (g - r)", "ug_gr"), r("(g - r) - (r - i)", "gr_ri"), r("(r - i) - (i - z)", "ri_iz"),
       r("u + g + r + i + z", "mag_sum"), r("(u + g + r + i + z) / 5", "mag_mean"),
       "CAST(redshift < 0 AS INTEGER) AS redshift_is_neg", r("redshift * redshift", "redshift_sq"),
       r("redshift * (r - i)", "redshift_r_i"), r("redshift * (i - z)", "redshift_i_z"),
       r("u - r", "u_r"), r("g - i", "g_i"), r("u - z", "u_z"),
       "CAST(redshift < 5e-2 AS INTEGER) AS redshift_low",
       r("redshift * (u - r)", "redshift_u_r"), r("redshift * (g - i)", "redshift_g_i")]
)


@query(
    "p15_feature_set_all_v3",
    f"WITH {PHOTO}, {_EDGE_AB}, {_QZ} SELECT id, {', '.join(_V3)} FROM photo, e, q WHERE source = 'train'",
)
def p15(spark, sf):
    train = photo(spark, sf).where("source = 'train'").select("id", *RAW)
    return rounded(recipes.FeatureRecipe("all_v3").fit(train).transform(train).drop(*RAW))


@query(
    "p15_feature_set_base",
    f"WITH {PHOTO}, {_QZ} SELECT id, "
    + ", ".join([r("alpha * delta", "alpha_delta"), r("sin(radians(alpha))", "sin_alpha"),
                 r("cos(radians(alpha))", "cos_alpha"), r("sin(radians(delta))", "sin_delta"),
                 r("cos(radians(delta))", "cos_delta")]
                + [r(f"{a} / (abs({b}) + 1e-6)", f"ratio_{a}_{b}") for a, b in PAIRS]
                + ["CAST(len(list_filter(e, lambda x: x < redshift)) AS INTEGER) AS redshift_bin"])
    + " FROM photo, q WHERE source = 'test'",
)
def p15_base(spark, sf):
    ph = photo(spark, sf).select("id", "source", *RAW)
    recipe = recipes.FeatureRecipe("base").fit(ph.where("source = 'train'"))
    return rounded(recipe.transform(ph.where("source = 'test'")).drop("source", *RAW))


@query(
    "p15_prepare_all",
    f"""WITH {PHOTO}, {_QZ},
    f AS (SELECT coalesce(spectral_type, '__NA__') AS s, count(*) / (SELECT count(*) FROM photo WHERE source = 'train') AS sf
      FROM photo WHERE source = 'train' GROUP BY 1),
    c AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (
      SELECT DISTINCT coalesce(spectral_type, '__NA__') AS s FROM photo WHERE source <> 'aux'))
    SELECT id, code AS spectral_type, {r('coalesce(sf, 0e0)', 'spectral_type_freq')},
      {r('sf * len(list_filter(e, lambda x: x < redshift))', 'spec_redshift_bin')}
    FROM photo JOIN c ON coalesce(spectral_type, '__NA__') = c.s JOIN f ON f.s = c.s, q WHERE source = 'test'""",
)
def p15_prepare(spark, sf):
    ph = photo(spark, sf)
    train = ph.where("source = 'train'").drop("source", "y")
    test = ph.where("source = 'test'").drop("source", "y", "class")
    _, made, features = recipes.prepare(train, test, "all")
    keep = ["spectral_type", "spectral_type_freq", "spec_redshift_bin"]
    assert set(keep) <= set(features)
    return rounded(made.select("id", *keep))


@query("p16_select_profile", _photo("id, alpha, delta, u, g, r, i, z, redshift, spectral_type, galaxy_population"))
def p16(spark, sf):
    return recipes.select_profile(photo(spark, sf).withColumn("extra_flag", F.lit(1)), "minimal")


@query("p17_select_top_features", _photo("id, redshift, g, u, alpha"))
def p17(spark, sf):
    ranked = ["redshift", "no_such_feature", "g", "u", "alpha", "z"]
    return recipes.select_top_features(photo(spark, sf), ranked, 4)[0]


@query(
    "p18_source_flags",
    _photo("id, source, CAST(source = 'aux' AS INTEGER) AS is_orig, CAST(source = 'test' AS INTEGER) AS is_test"),
)
def p18(spark, sf):
    ph = photo(spark, sf).select("id", "source")
    frames = {s: ph.where(F.col("source") == s).select("id") for s in ("train", "test", "aux")}
    return R.source_flags(stack_sources(frames))


@query(
    "p19_polynomial",
    _photo("id, " + ", ".join(
        [r(f"{a} * {b}", f"poly_{a}_{b}") for a, b in [("u", "u"), ("u", "g"), ("u", "redshift"),
         ("g", "g"), ("g", "redshift"), ("redshift", "redshift")]])),
)
def p19(spark, sf):
    df = R.polynomial(photo(spark, sf).select("id", "u", "g", "redshift"), ["u", "g", "redshift"])
    return rounded(df.drop("u", "g", "redshift"))
