"""Category codes and supervised encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions import codes
from sparktab.operators import categories as C
from sparktab.operators import encoders as E
from suite.common import PHOTO, photo, query, r, rounded, rs, table
from suite.folds import _CODE, coded_events

_TOK = "coalesce({c}, '__NA__')"
SPEC, POP = _TOK.format(c="spectral_type"), _TOK.format(c="galaxy_population")


def _split(spark, sf, *cols):
    ph = photo(spark, sf).select("id", "source", "y", *cols)
    return {s: ph.where(F.col("source") == s) for s in ("train", "test", "aux")}


@query("c1_cross", f"WITH {PHOTO} SELECT id, {SPEC} || '|' || {POP} AS joint FROM photo")
def c1(spark, sf):
    pair = [F.col("spectral_type"), F.col("galaxy_population")]
    return photo(spark, sf).select("id", codes.cross(pair).alias("joint"))


_H2 = "(({a} + 1000003) * 1000003 + ({b} + 9176)) % 2147483647"


@query(
    "c2_hash_cross",
    f"""WITH k AS (SELECT event_id, CAST(user_id AS HUGEINT) AS a, CAST(floor(value) AS HUGEINT) AS b,
      CAST(event_id % 7 - 1 AS HUGEINT) AS c FROM events)
    SELECT event_id, CAST({_H2.format(a='a', b='b')} AS BIGINT) AS h2,
      CAST((((a + 1000003) * 1000003 + (b + 9176)) * 1000003 + (c + 17191)) % 2147483647 AS BIGINT) AS h3 FROM k""",
)
def c2(spark, sf):
    a, b = F.col("user_id"), F.floor("value")
    c = F.col("event_id") % 7 - 1
    return table(spark, sf, "events").select(
        "event_id", codes.hash_cross2(a, b).alias("h2"), codes.hash_cross3(a, b, c).alias("h3")
    )


_CR = {"spec": "CASE spectral_type WHEN 'M' THEN 0 WHEN 'G/K' THEN 1 WHEN 'A/F' THEN 2 WHEN 'O/B' THEN 3 ELSE -1 END",
       "pop": "CASE galaxy_population WHEN 'Blue_Cloud' THEN 0 WHEN 'Red_Sequence' THEN 1 ELSE -1 END",
       "cell": "CAST(floor(alpha) AS INTEGER)"}


def _h2(a: str, b: str, name: str) -> str:
    ha, hb = f"CAST({a} AS BIGINT)", f"CAST({b} AS BIGINT)"
    return f"{_H2.format(a=ha, b=hb)} AS {name}"


@query(
    "c3_all_crosses",
    f"""WITH {PHOTO}, k AS (SELECT id, {', '.join(f'{e} AS {n}' for n, e in _CR.items())} FROM photo)
    SELECT id, {_h2('spec', 'pop', 'COMBO_spec__pop')}, {_h2('spec', 'pop', 'PAIR_spec__pop')},
      {_h2('spec', 'cell', 'PAIR_spec__cell')}, {_h2('pop', 'cell', 'PAIR_pop__cell')},
      CAST((((CAST(spec AS HUGEINT) + 1000003) * 1000003 + (pop + 9176)) * 1000003 + (cell + 17191)) % 2147483647 AS BIGINT) AS TRIO_spec__pop__cell
    FROM k""",
)
def c3(spark, sf):
    df = photo(spark, sf).select(
        "id",
        codes.ordinal_map(F.col("spectral_type"), {"M": 0, "G/K": 1, "A/F": 2, "O/B": 3}).alias("spec"),
        codes.ordinal_map(F.col("galaxy_population"), {"Blue_Cloud": 0, "Red_Sequence": 1}).alias("pop"),
        codes.floor_code(F.col("alpha")).alias("cell"),
    )
    out = codes.all_crosses(df, ["spec", "pop", "absent", "cell"], [("spec", "pop"), ("spec", "absent")])
    return out.drop("spec", "pop", "cell")


@query(
    "c4_ordinal_map",
    f"WITH {PHOTO} SELECT id, {_CR['spec']} AS spec_code, {_CR['pop']} AS pop_code FROM photo",
)
def c4(spark, sf):
    return photo(spark, sf).select(
        "id",
        codes.ordinal_map(F.col("spectral_type"), {"M": 0, "G/K": 1, "A/F": 2, "O/B": 3}).alias("spec_code"),
        codes.ordinal_map(F.col("galaxy_population"), {"Blue_Cloud": 0, "Red_Sequence": 1}).alias("pop_code"),
    )


def _stacked(frames):
    """All encoded frames, each row with the number of its frame."""
    out = frames[0].withColumn("frame", F.lit(0))
    for i, frame in enumerate(frames[1:], 1):
        out = out.unionByName(frame.withColumn("frame", F.lit(i)))
    return out


@query(
    "c5_label_encode",
    """WITH v AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part))
    SELECT p_partkey, code AS p_name_code, CAST(p_partkey % 3 AS INTEGER) AS frame FROM part JOIN v USING (p_name)""",
)
def c5(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    frames = [part.where(F.col("p_partkey") % 3 == i) for i in range(3)]
    return _stacked(C.label_encode(frames, "p_name")).drop("p_name")


@query(
    "c6_factorize",
    """WITH f AS (SELECT user_id, min(event_id) AS m FROM events WHERE event_id % 4 = 0 AND user_id % 5 <> 0 GROUP BY 1),
    c AS (SELECT user_id, row_number() OVER (ORDER BY m) - 1 AS code FROM f)
    SELECT event_id, coalesce(code, -1) AS user_id_code FROM events LEFT JOIN c USING (user_id)""",
)
def c6(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    fit = ev.where("event_id % 4 = 0 AND user_id % 5 <> 0")
    return C.factorize(fit, ev, "user_id", "event_id").drop("user_id")


@query(
    "c7_frequency_codes",
    """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS v, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1 HAVING count(*) >= 9),
    c AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS code FROM n)
    SELECT o_orderkey, coalesce(code, 0) AS o_custkey_freq_code FROM orders LEFT JOIN c ON CAST(o_custkey AS VARCHAR) = v""",
)
def c7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return C.frequency_codes(o.where("o_orderkey % 3 <> 0"), o, "o_custkey", 9).drop("o_custkey")


@query(
    "c8_sorted_codes_per_fold",
    f"""WITH {PHOTO}, t AS (SELECT id, {SPEC} || '|' || {POP} AS j FROM photo WHERE source <> 'aux'),
    c AS (SELECT j, row_number() OVER (ORDER BY j) - 1 AS code FROM (SELECT DISTINCT j FROM t))
    SELECT id, code AS joint_code, CASE WHEN source = 'test' THEN 2 WHEN id % 5 = 2 THEN 1 ELSE 0 END AS frame
    FROM photo JOIN t USING (id) JOIN c USING (j)""",
)
def c8(spark, sf):
    made = codes.cross([F.col("spectral_type"), F.col("galaxy_population")])
    parts = _split(spark, sf, made.alias("joint"))
    train = parts["train"].where("id % 5 <> 2")
    valid = parts["train"].where("id % 5 = 2")
    return _stacked(C.label_encode([train, valid, parts["test"]], "joint")).select("id", "joint_code", "frame")


_CARDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]


@query(
    "c9_cardinality_select",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in _CARDS)
    + ") WHERE n_distinct <= 120",
)
def c9(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = C.cardinality_select(li, _CARDS, 120, family="l_")
    return C.cardinality(li, _CARDS).where(F.col("column").isin(kept))


def _freq_sql(v: str, name: str) -> str:
    return f"""WITH {PHOTO}, f AS (SELECT {v} AS v, count(*) / (SELECT count(*) FROM photo WHERE source = 'train') AS s
      FROM photo WHERE source = 'train' GROUP BY 1)
    SELECT id, {r('coalesce(s, 0e0)', name)} FROM photo LEFT JOIN f ON {v} = f.v WHERE source = 'test'"""


@query("c10_frequency_encode", _freq_sql(SPEC, "spectral_type_freq"))
def c10(spark, sf):
    parts = _split(spark, sf, "spectral_type")
    out = C.frequency_encode(parts["train"], parts["test"], "spectral_type")
    return rounded(out.select("id", "spectral_type_freq"))


@query("c11_joint_frequency_encode", _freq_sql(f"{SPEC} || '|' || {POP}", "joint_freq"))
def c11(spark, sf):
    cats = ["spectral_type", "galaxy_population"]
    parts = _split(spark, sf, *cats)
    out = C.joint_frequency_encode(parts["train"], parts["test"], cats, "joint_freq")
    return rounded(out.select("id", "joint_freq"))


@query(
    "c12_count_encode",
    """WITH n AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1)
    SELECT o_orderkey, coalesce(c, 0) AS o_custkey_count, """
    + r("ln(1 + coalesce(c, 0))", "o_custkey_log_count") + ", "
    + r("coalesce(c, 0) / (SELECT count(*) FROM orders)", "o_custkey_share", 9)
    + " FROM orders LEFT JOIN n USING (o_custkey)",
)
def c12(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    frames = [o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 4 <> 0")]
    out = C.count_encode(frames, o, ["o_custkey"]).drop("o_custkey")
    share = F.floor(F.col("o_custkey_share") * 1e9 + 0.5) / 1e9
    ln = F.floor(F.col("o_custkey_log_count") * 1e6 + 0.5) / 1e6
    return out.withColumns({"o_custkey_share": share, "o_custkey_log_count": ln})


@query(
    "c13_one_hot",
    "SELECT event_id, " + ", ".join(
        f"CAST(event_type = '{v}' AS INTEGER) AS type_{v}" for v in ["click", "error", "purchase", "signup", "view"])
    + " FROM events",
)
def c13(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return codes.one_hot(ev, "event_type", C.levels(ev, "event_type"), "type").drop("event_type")


_EV = f"ev AS (SELECT event_id, user_id, value, CAST(event_id % 5 AS INTEGER) AS inner_fold, {_CODE} AS y FROM events)"


@query(
    "e1_target_encode",
    f"""WITH {_EV}, b AS (SELECT *, CAST(y = 2 AS INTEGER) AS t FROM ev),
    fit AS (SELECT * FROM b WHERE event_id % 2 = 0 AND user_id % 13 <> 0), g AS (SELECT avg(t) AS g FROM fit),
    s AS (SELECT user_id, (sum(t) + 10e0 * g) / (count(*) + 10e0) AS e FROM fit, g GROUP BY user_id, g)
    SELECT event_id, {r('coalesce(e, g)', 'user_id_te')} FROM b LEFT JOIN s USING (user_id), g""",
)
def e1(spark, sf):
    ev = coded_events(spark, sf).select(
        "event_id", "user_id", (F.col("y") == 2).cast("int").alias("t")
    )
    fit = ev.where("event_id % 2 = 0 AND user_id % 13 <> 0")
    return rounded(E.target_encode(fit, ev, ["user_id"], "t", 10.0).select("event_id", "user_id_te"))


@query(
    "e2_leave_one_out_encode",
    f"""WITH {_EV}, b AS (SELECT event_id, CAST(user_id * 1000 + event_id % 97 AS BIGINT) AS k, CAST(y = 2 AS INTEGER) AS t FROM ev),
    g AS (SELECT avg(t) AS g FROM b), s AS (SELECT k, sum(t) AS s, count(*) AS n FROM b GROUP BY k)
    SELECT event_id, {r('CASE WHEN n = 1 THEN g ELSE (s - t) / (n - 1e0) END', 'k_loo')},
      {r('(s - t + 5e0 * g) / (n - 1 + 5e0)', 'k_loo5')} FROM b JOIN s USING (k), g""",
)
def e2(spark, sf):
    ev = coded_events(spark, sf).select(
        "event_id", (F.col("user_id") * 1000 + F.col("event_id") % 97).alias("k"),
        (F.col("y") == 2).cast("int").alias("t"),
    )
    out = E.leave_one_out_encode(ev, "k", "t", 0.0)
    out = E.leave_one_out_encode(out, "k", "t", 5.0, "k_loo5")
    return rounded(out.select("event_id", "k_loo", "k_loo5"))


def _sums(y: str = "y", k: int = 5) -> str:
    return ", ".join(f"sum(CASE WHEN {y} = {c} THEN 1e0 ELSE 0e0 END) AS s{c}" for c in range(k))


_TR = f"""{_EV}, tr AS (SELECT * FROM ev WHERE event_id % 3 <> 0), ap AS (SELECT * FROM ev WHERE event_id % 3 = 0),
    f AS (SELECT user_id, inner_fold, count(*) AS n, {_sums()} FROM tr GROUP BY ALL),
    t AS (SELECT user_id, count(*) AS n, {_sums()} FROM tr GROUP BY ALL),
    g AS (SELECT count(*) AS n, {_sums()} FROM tr)"""


@query(
    "e3_fold_safe_encode",
    f"""WITH {_TR}
    SELECT event_id, 'train' AS part, {', '.join(r(f'(t.s{c} - f.s{c} + 16e0 * g.s{c} / g.n) / (t.n - f.n + 16e0)', f'TE_user_id_{c}') for c in range(5))}
    FROM tr JOIN f USING (user_id, inner_fold) JOIN t USING (user_id), g
    UNION ALL
    SELECT event_id, 'apply', {', '.join(r(f'coalesce((t.s{c} + 16e0 * g.s{c} / g.n) / (t.n + 16e0), g.s{c} / g.n)', f'TE_user_id_{c}') for c in range(5))}
    FROM ap LEFT JOIN t USING (user_id), g""",
)
def e3(spark, sf):
    ev = coded_events(spark, sf).select(
        "event_id", "user_id", "y", (F.col("event_id") % 5).cast("int").alias("inner")
    )
    train, applied = E.fold_safe_encode(
        ev.where("event_id % 3 <> 0"), ["user_id"], "y", 5, "inner", 16.0, ev.where("event_id % 3 = 0")
    )
    both = train.withColumn("part", F.lit("train")).unionByName(applied.withColumn("part", F.lit("apply")))
    return rounded(both.drop("user_id", "y", "inner"))


_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _packed_sql() -> str:
    """Totals of the value without those of the row's fold, column by column."""
    names = ["A", "N", "R"]
    parts, joins, cells = [], [], []
    for i, c in enumerate(_WIDE):
        parts.append(f"f{i} AS (SELECT {c}, inner_fold, count(*) AS n, {_sums(k=3)} FROM li GROUP BY ALL)")
        parts.append(f"t{i} AS (SELECT {c}, sum(n) AS n, {', '.join(f'sum(s{k}) AS s{k}' for k in range(3))} FROM f{i} GROUP BY ALL)")
        joins.append(f"JOIN f{i} ON li.{c} = f{i}.{c} AND li.inner_fold = f{i}.inner_fold JOIN t{i} ON li.{c} = t{i}.{c}")
        cells += [
            r(f"(t{i}.s{k} - f{i}.s{k} + 16e0 * g.s{k} / g.n) / (t{i}.n - f{i}.n + 16e0)", f"TE_{c}_{names[k]}") for k in range(3)
        ]
    return (
        "WITH li AS (SELECT *, CAST(l_linenumber % 3 AS INTEGER) AS inner_fold, strpos('ANR', l_returnflag) - 1 AS y FROM lineitem), "
        f"g AS (SELECT count(*) AS n, {_sums(k=3)} FROM li), {', '.join(parts)} "
        f"SELECT li.l_orderkey, li.l_partkey, li.l_linenumber, {', '.join(cells)} FROM li {' '.join(joins)}, g"
    )


@query("e3_packed_wide_encode", _packed_sql())
def e3_packed(spark, sf):
    """Five keys at once by the packed join, whatever their sizes."""
    li = table(spark, sf, "lineitem").select(
        "l_linenumber", *_WIDE, (F.col("l_linenumber") % 3).cast("int").alias("inner_fold"),
        (F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1).alias("y"),
    )
    out, _ = E.fold_safe_encode(li, _WIDE, "y", 3, "inner_fold", 16.0, class_names=["A", "N", "R"], packed=True)
    return rounded(out.drop("l_suppkey", "l_extendedprice", "l_shipdate", "inner_fold", "y"))


def _auto(n: str, s: str, g: str) -> str:
    m = f"(({s}) / ({n}))"
    return (
        f"CASE WHEN ({n}) = 0 THEN ({g}) ELSE (({n}) * (({g}) * (1 - ({g}))) / (({n}) * (({g}) * (1 - ({g}))) + {m} * (1 - {m}))) * {m}"
        f" + (1 - (({n}) * (({g}) * (1 - ({g}))) / (({n}) * (({g}) * (1 - ({g}))) + {m} * (1 - {m})))) * ({g}) END"
    )


@query(
    "e4_auto_smooth_encode",
    f"""WITH {_TR}, gf AS (SELECT inner_fold, count(*) AS n, {_sums()} FROM tr GROUP BY inner_fold)
    SELECT event_id, 'train' AS part, {', '.join(r(_auto('t.n - f.n', f't.s{c} - f.s{c}', f'(g.s{c} - gf.s{c}) / (g.n - gf.n)'), f'TE_user_id_{c}') for c in range(5))}
    FROM tr JOIN f USING (user_id, inner_fold) JOIN t USING (user_id) JOIN gf USING (inner_fold), g
    UNION ALL
    SELECT event_id, 'apply', {', '.join(r('CASE WHEN t.n IS NULL THEN ' + f'g.s{c} / g.n' + ' ELSE ' + _auto('t.n', f't.s{c}', f'g.s{c} / g.n') + ' END', f'TE_user_id_{c}') for c in range(5))}
    FROM ap LEFT JOIN t USING (user_id), g""",
)
def e4(spark, sf):
    ev = coded_events(spark, sf).select(
        "event_id", "user_id", "y", (F.col("event_id") % 5).cast("int").alias("inner")
    )
    train, applied = E.auto_smooth_encode(
        ev.where("event_id % 3 <> 0"), ["user_id"], "y", 5, "inner", ev.where("event_id % 3 = 0")
    )
    both = train.withColumn("part", F.lit("train")).unionByName(applied.withColumn("part", F.lit("apply")))
    return rounded(both.drop("user_id", "y", "inner"))


@query(
    "e5_encoders_needed",
    f"""WITH {_TR}
    SELECT event_id, {r('(t.s1 - f.s1 + 16e0 * g.s1 / g.n) / (t.n - f.n + 16e0)', 'TE_user_id_1')}
    FROM tr JOIN f USING (user_id, inner_fold) JOIN t USING (user_id), g""",
)
def e5(spark, sf):
    """Only the encoder whose output is kept is computed."""
    ev = coded_events(spark, sf).select(
        "event_id", "user_id", "y", (F.col("event_id") % 5).cast("int").alias("inner"),
        F.floor("value").alias("bucket"),
    )
    kept = ["TE_user_id_1"]
    cols = E.encoders_needed(kept, ["user_id", "bucket"], 5)
    train, _ = E.fold_safe_encode(ev.where("event_id % 3 <> 0"), cols, "y", 5, "inner", 16.0)
    return rounded(train.select("event_id", *kept))


@query(
    "e6_aux_prior_encode",
    f"""WITH {PHOTO}, p AS (SELECT id, y, source, CAST(floor(u * 10) AS INTEGER) AS u_key FROM photo),
    g AS (SELECT count(*) AS n, {_sums('y', 3)} FROM p WHERE source = 'aux'),
    t AS (SELECT u_key, count(*) AS n, {_sums('y', 3)} FROM p WHERE source = 'aux' GROUP BY u_key)
    SELECT id, {', '.join(r(f'coalesce((t.s{c} + 30e0 * g.s{c} / g.n) / (t.n + 30e0), g.s{c} / g.n)', f'u_key_aux_{c}') for c in range(3))},
      coalesce(t.n, 0) AS u_key_aux_count, {r('ln(1 + coalesce(t.n, 0))', 'u_key_aux_log_count')}
    FROM p LEFT JOIN t USING (u_key), g WHERE source <> 'aux'""",
)
def e6(spark, sf):
    ph = photo(spark, sf).select("id", "y", "source", F.floor(F.col("u") * 10).cast("int").alias("u_key"))
    out = E.aux_prior_encode(ph.where("source = 'aux'"), ph.where("source <> 'aux'"), ["u_key"], "y", 3)
    return rounded(out.drop("y", "source", "u_key"))


@query(
    "e11_class_weights",
    """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
    w AS (SELECT o_orderstatus, (SELECT count(*) FROM orders) / (3e0 * n) AS b,
      ((SELECT count(*) FROM orders) - n) / (n * 1e0) AS o FROM c)
    SELECT o_orderkey, """ + ", ".join([
        r("b", "balanced"), r("sqrt(b) * CASE o_orderstatus WHEN 'F' THEN 2e0 WHEN 'P' THEN 25e-2 ELSE 1e0 END", "shaped"),
        r("CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 325e-2 ELSE 5e0 END", "fixed"),
        r("CASE o_orderstatus WHEN 'O' THEN o ELSE 1e0 END", "ovr")])
    + " FROM orders JOIN w USING (o_orderstatus)",
)
def e11(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    out = E.class_weights(o, "o_orderstatus", out="balanced")
    out = E.class_weights(out, "o_orderstatus", 0.5, {"F": 2.0, "P": 0.25}, out="shaped")
    out = E.class_weights(out, "o_orderstatus", fixed={"F": 1, "O": 3.25, "P": 5}, out="fixed")
    return rounded(E.one_vs_rest_weight(out, "o_orderstatus", "O", "ovr").drop("o_orderstatus"))
