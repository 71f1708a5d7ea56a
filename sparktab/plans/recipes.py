"""Named feature recipes, column profiles and ranked feature selection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.codes import token
from sparktab.functions.rowwise import ratio, share_times_bin
from sparktab.operators.binning import EqualWidthBinner, QuantileBinner
from sparktab.operators.categories import frequency_encode, joint_frequency_encode, label_encode
from sparktab.operators.joins import stack_sources

BANDS = ("u", "g", "r", "i", "z")
CATEGORIES = ("spectral_type", "galaxy_population")

# Feature groups of every recipe (fixed values).
RECIPES = {
    "base": ("coords", "ratios", "redshift_bin"),
    "color": ("coords", "ratios", "colors", "redshift_bin"),
    "color_redshift": ("coords", "ratios", "colors", "redshift_bin", "redshift_terms"),
    "all_no_coord_bin": ("colors", "coords", "redshift_bin", "redshift_terms"),
    "all": ("colors", "coords", "sky_cell", "redshift_bin", "redshift_terms"),
    "all_v2": ("colors", "coords", "sky_cell", "redshift_bin", "redshift_terms", "brightness"),
    "all_v3": (
        "colors", "coords", "sky_cell", "redshift_bin", "redshift_terms", "brightness",
        "wide_colors",
    ),
}
WITH_FREQUENCIES = ("all_no_coord_bin", "all", "all_v2", "all_v3")


class FeatureRecipe:
    """A named feature set: bins are fitted on one frame, the rest is row-wise."""

    def __init__(self, name: str, use_coords: bool = True):
        if name not in RECIPES:
            raise ValueError(f"unknown feature set {name!r}; choose from {tuple(RECIPES)}")
        self.name = name
        self.groups = [g for g in RECIPES[name] if use_coords or g not in ("coords", "sky_cell")]
        self.cells: EqualWidthBinner | None = None
        self.redshift: QuantileBinner | None = None

    def fit(self, df: DataFrame) -> FeatureRecipe:
        if "sky_cell" in self.groups:
            self.cells = EqualWidthBinner(["alpha", "delta"], 20).fit(df)
        self.redshift = QuantileBinner(["redshift"], 10, "right", "trim", missing=None).fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for group in self.groups:
            df = getattr(self, f"_{group}")(df)
        return df

    def _coords(self, df: DataFrame) -> DataFrame:
        ra, dec = F.radians("alpha"), F.radians("delta")
        return df.withColumns(
            {
                "alpha_delta": F.col("alpha") * F.col("delta"),
                "sin_alpha": F.sin(ra),
                "cos_alpha": F.cos(ra),
                "sin_delta": F.sin(dec),
                "cos_delta": F.cos(dec),
            }
        )

    def _sky_cell(self, df: DataFrame) -> DataFrame:
        return self.cells.cell(df, "alpha", "delta", "alpha_delta_bin")

    def _colors(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{a}_{b}": F.col(a) - F.col(b) for a, b in zip(BANDS, BANDS[1:])})

    def _ratios(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {f"ratio_{a}_{b}": ratio(F.col(a), F.col(b)) for a, b in combinations(BANDS, 2)}
        )

    def _redshift_bin(self, df: DataFrame) -> DataFrame:
        return df.withColumn("redshift_bin", self.redshift.code("redshift"))

    def _redshift_terms(self, df: DataFrame) -> DataFrame:
        new = {"log1p_abs_redshift": F.log1p(F.abs("redshift"))}
        new.update({f"redshift_{c}": F.col("redshift") * F.col(c) for c in ("u_g", "g_r")})
        return df.withColumns(new)

    def _brightness(self, df: DataFrame) -> DataFrame:
        bands = F.col("u") + F.col("g") + F.col("r") + F.col("i") + F.col("z")
        z = F.col("redshift")
        return df.withColumns(
            {
                "ug_gr": F.col("u_g") - F.col("g_r"),
                "gr_ri": F.col("g_r") - F.col("r_i"),
                "ri_iz": F.col("r_i") - F.col("i_z"),
                "mag_sum": bands,
                "mag_mean": bands / 5,
                "redshift_is_neg": (z < 0).cast("int"),
                "redshift_sq": z * z,
                "redshift_r_i": z * F.col("r_i"),
                "redshift_i_z": z * F.col("i_z"),
            }
        )

    def _wide_colors(self, df: DataFrame) -> DataFrame:
        z = F.col("redshift")
        return df.withColumns(
            {
                "u_r": F.col("u") - F.col("r"),
                "g_i": F.col("g") - F.col("i"),
                "u_z": F.col("u") - F.col("z"),
                "redshift_low": (z < 0.05).cast("int"),
                "redshift_u_r": z * (F.col("u") - F.col("r")),
                "redshift_g_i": z * (F.col("g") - F.col("i")),
            }
        )


def prepare(
    train: DataFrame, test: DataFrame, name: str, id_col: str = "id", target: str = "class",
    use_coords: bool = True, encode_categories: bool = True,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Recipe, category shares and sorted category codes for both frames, and feature names.

    Bins and shares are fitted on train; codes cover both frames.
    """
    recipe = FeatureRecipe(name, use_coords).fit(train)
    cats = [c for c in CATEGORIES if c in train.columns]
    made = {}
    for tag, frame in (("train", train), ("test", test)):
        out = recipe.transform(frame)
        if name in WITH_FREQUENCIES:
            for c in cats:
                out = frequency_encode(train, out, c)
        if name == "all_v3" and len(cats) == 2:
            out = joint_frequency_encode(train, out, cats, "_joint_cat_freq")
        if name in WITH_FREQUENCIES and "spectral_type" in cats:
            out = share_times_bin(out, "spectral_type_freq", "redshift_bin", "spec_redshift_bin")
        made[tag] = out
    if encode_categories:
        for c in cats:
            a, b = label_encode([made["train"], made["test"]], c, f"__{c}")
            made["train"] = a.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
            made["test"] = b.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    else:
        for tag in made:
            made[tag] = made[tag].withColumns({c: token(F.col(c)) for c in cats})
    from sparktab.sources.tables import align_columns

    features = align_columns(made["train"], made["test"], exclude=(id_col, target))
    return made["train"], made["test"], features


RAW_COLUMNS = ("alpha", "delta", *BANDS, "redshift")
NEXT_COLORS = tuple(f"{a}_{b}" for a, b in zip(BANDS, BANDS[1:]))
SKIP_COLORS = tuple(f"{a}_{b}" for a, b in zip(BANDS, BANDS[2:]))
BRIGHTNESS = ("mag_mean", "mag_std", "mag_range")
REDSHIFT_FORMS = ("redshift_abs", "redshift_log1p", "redshift_sq")
DIRECTIONS = (*(f"{f}_{c}" for c in ("alpha", "delta") for f in ("sin", "cos")), "sky_x", "sky_y", "sky_z")
SKY_COLUMNS = (*RAW_COLUMNS, *DIRECTIONS, *REDSHIFT_FORMS, *NEXT_COLORS, SKIP_COLORS[0], *BRIGHTNESS[:2])
MINIMAL_COLUMNS = (*RAW_COLUMNS, *NEXT_COLORS, *SKIP_COLORS, *BRIGHTNESS, *REDSHIFT_FORMS[:2], "qso_color_plane")
# Name words of the column profiles (fixed values).
COLOR_WORDS = (*BANDS, "redshift", "mag", "curv", "curvature", "slope", "uv", "qso", "sequence")
SKY_WORDS = ("alpha", "delta", "sky")
PROFILES = ("full", "color", "sky", "minimal", "numeric_only", "rounded", "priorheavy")
ALIASES = {"compact": "minimal", "numeric": "numeric_only"}


def select_profile(df: DataFrame, profile: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Column subset by profile; text columns count as categories.

    A name matches a word when one of its underscore-separated parts equals it. Rounded categories are
    named with the word "round" or end in the number of digits (``_r1``).
    """
    profile = ALIASES.get(profile, profile)
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; choose from {PROFILES}")
    if profile == "full":
        return df
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    numbers = [c for c in df.columns if c not in texts]

    def having(cols: Sequence[str], words: Sequence[str]) -> list[str]:
        return [c for c in cols if set(re.split(r"_", c.lower())) & set(words)]

    base = [c for c in texts if c in CATEGORIES]
    chosen = {
        "color": having(numbers, COLOR_WORDS) + base + having(texts, COLOR_WORDS),
        "sky": [c for c in numbers if c in SKY_COLUMNS] + base + having(texts, SKY_WORDS),
        "minimal": [c for c in numbers if c in MINIMAL_COLUMNS] + base,
        "numeric_only": numbers,
        "rounded": numbers + [c for c in texts if "round" in c or re.search(r"_r\d$", c)],
        "priorheavy": numbers + texts,
    }[profile]
    return df.select(*[c for c in df.columns if c in keep or c in chosen])


# Named colour scores on difference columns (fixed values).
COLOR_SCORES = {
    "uvx_u_g_minus_0p6": {"u_g": 1, "const": -0.6},
    "uvx_plane": {"u_g": 1, "g_r": -0.75, "const": -0.18},
    "lrg_cperp": {"r_i": 1, "g_r": -0.25, "const": -0.18},
    "lrg_cparallel": {"g_r": 0.7, "r_i": 1.2, "const": -0.216},
    "qso_color_plane": {"u_g": 1, "g_r": -0.8, "r_i": 0.35, "i_z": -0.2},
    "u_r_minus_2p2": {"u_r": 1, "const": -2.2},
}
# Soft redshift indicators: name, kind, centre, scale (fixed values).
REDSHIFT_INDICATORS = (
    ("star_z_peak", "peak", 0.0, 0.003),
    ("galaxy_z_low_peak", "gauss", 0.1, 0.25),
    ("qso_z_high_sigmoid", "ramp", 0.7, 0.25),
    ("qso_z_veryhigh_sigmoid", "ramp", 2.2, 1 / 3),
)
REDSHIFT_RANGE = (-0.05, 5.0)


def distance_proxies(df: DataFrame, cols: Sequence[str] = BANDS, eps: float = 1e-6) -> DataFrame:
    """Distance modulus ``5*log10(|z|+eps)`` and band minus modulus."""
    df = df.withColumn("redshift_distmod_proxy", 5 * F.log10(F.abs("redshift") + F.lit(eps)))
    return df.withColumns(
        {f"{c}_absmag_proxy": F.col(c) - F.col("redshift_distmod_proxy") for c in cols}
    )


def select_top_features(
    df: DataFrame, ranked: Iterable[str], n: int | None = None, keep: Sequence[str] = ("id",)
) -> tuple[DataFrame, list[str]]:
    """The first ``n`` ranked names that exist, in rank order, and the absent ones."""
    ranked = list(ranked)
    have = set(df.columns)
    present = [c for c in ranked if c in have][: n or len(ranked)]
    absent = [c for c in ranked if c not in have]
    return df.select(*[c for c in keep if c not in present], *present), absent


def combine(train: DataFrame, test: DataFrame, aux: DataFrame | None = None) -> DataFrame:
    """Train, test and auxiliary rows in one frame with a source tag."""
    frames = {"train": train, "test": test}
    if aux is not None:
        frames["aux"] = aux
    return stack_sources(frames)
