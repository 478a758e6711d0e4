"""Names, numbers and ranges that results depend on.

Column names are lower case with ``_`` for ``/`` because Spark compares names without
case: ``temp_c`` is the temperature and ``t_min`` the residence time.
"""

# --- fixed values: targets -------------------------------------------------------
YIELDS = ["b_y", "c_y", "a_y", "g_y"]
BASIS_YIELDS = ["b_y", "c_y", "a_y", "g_y", "gw_y"]
ENERGY_CARBON = ["e_b", "e_h", "c_b", "c_h"]
BIOOIL = ["hhv_biooil", "c_biooil", "o_biooil", "h_biooil", "n_biooil", "s_biooil"]
BIOCHAR = ["hhv_biochar", "c_biochar", "o_biochar", "h_biochar", "n_biochar", "s_biochar"]
RATIOS = ["o_c_biooil", "h_c_biooil", "o_c_biochar", "h_c_biochar"]
TARGETS = YIELDS + ENERGY_CARBON + BIOOIL + BIOCHAR + RATIOS
N_TARGETS = 24
GROUPING_COLUMNS = ["doi", "ref", "feedstock", "temp_c"]

# --- fixed values: identifier prefixes, tried in this order ------------------------
ID_PREFIXES = [
    "https://doi.org/",
    "http://doi.org/",
    "http://dx.doi.org/",
    "dx.doi.org/",
    "doi:",
]

# --- fixed values: interaction features (name, left, right) ------------------------
CORE_INTERACTIONS = [
    ("int_t_ic", "temp_c", "ic"),
    ("int_t_pressure", "temp_c", "pressure_effective_mpa"),
    ("int_ic_cat_ratio", "ic", "catalyst_biomass_ratio"),
    ("int_t_lignin", "temp_c", "lignin"),
    ("int_t_cellulose", "temp_c", "cellulose"),
    ("int_t_hemicellulose", "temp_c", "hemicellulose"),
    ("int_t_h_over_c", "temp_c", "h_c"),
    ("int_t_o_over_c", "temp_c", "o_c"),
    ("int_t_lri", "temp_c", "lri"),
    ("int_t_cat_ratio", "temp_c", "catalyst_biomass_ratio"),
]
ELEMENTAL_INTERACTIONS = [
    ("int_t_c", "temp_c", "c"),
    ("int_t_h", "temp_c", "h"),
    ("int_t_o", "temp_c", "o"),
    ("int_t_ash", "temp_c", "ash"),
    ("int_ash_lignin", "ash", "lignin"),
    ("int_ash_lri", "ash", "lri"),
    ("int_ash_c", "ash", "c"),
]

# --- fixed values: configured feature columns --------------------------------------
BASE_NUMERIC = [
    "o_c", "h_c", "ash", "hhv_feedstock", "o", "c", "h", "temp_c", "t_min", "ic",
    "lignin", "cellulose", "hemicellulose", "holocellulose", "lri_imputed",
    "pressure_effective_mpa", "catalyst_biomass_ratio",
]
SOLVENT_NUMERIC = [
    "frac_water", "frac_ethanol", "frac_methanol", "frac_isopropanol", "frac_acetone",
    "frac_glycerol", "acid_m", "base_m", "phenol_additive_wt_pct",
]
SOLVENT_FLAGS = ["acid_flag", "base_flag", "h_donor_flag"]
CATALYST_CLASSES = [
    "cat_acid", "cat_additive", "cat_alkaline", "cat_metal", "cat_none", "cat_other",
    "cat_oxide", "cat_phosphide", "cat_salt", "cat_sulfide", "cat_support", "cat_zeolite",
]
CATALYST_DESCRIPTORS = [
    "cat_is_base", "cat_base_strong", "cat_base_carbonate", "cat_is_acid",
    "cat_acid_strong", "cat_acid_weak", "cat_is_redox", "cat_has_noble",
    "cat_has_base_metal", "cat_bimetallic", "cat_is_zeolite", "cat_is_support",
    "cat_is_hdonor",
]
CATALYST_RATIO = "cat_ratio_log10"

# --- fixed values: raw export projections ------------------------------------------
EXPORT_METADATA = [
    "doi", "year", "feedstock", "family", "family_std", "tier", "temp_c", "t_min",
    "process_type_b", "process_type_a", "process_subtype", "process_subtype_raw",
    "paper_title", "ref",
]
EXPORT_NUMERIC = [
    "o_c", "h_c", "ash", "temp_c", "t_min", "ic", "hhv_feedstock", "lri", "lri_imputed",
    "c", "h", "o", "n", "s", "lignin", "cellulose", "hemicellulose",
    "pressure_effective_mpa", "pressure_autogenic", "catalyst_biomass_ratio",
    "water_biomass_ratio", "moisture_min", "moisture_max",
    "doi", "paper_title", "feedstock", "ref",
]
EXPORT_TARGETS = (
    YIELDS + ["gw_y"] + ENERGY_CARBON + BIOOIL + BIOCHAR + RATIOS
)
EXPORT_CATEGORICAL = [
    "family", "family_std", "tier", "process_type_b", "process_type_a",
    "process_subtype", "process_subtype_raw", "catalyst", "solvent_or_medium",
    "solvent_family", "vk_cluster_k2", "basis_class", "basis_is_carbon", "basis_is_daf",
    "basis_is_dry", "basis_carbon_basis", "basis_daf", "basis_dry_basis", "basis_other",
    "basis_unknown", "qa_flag", *SOLVENT_NUMERIC[:6], *SOLVENT_FLAGS, *SOLVENT_NUMERIC[6:],
]

# --- fixed values: legacy column names ----------------------------------------------
LEGACY_NAMES = {
    "temperature": "temp_c", "time": "t_min", "solid": "ic",
    "oil_yield": "b_y", "char_yield": "c_y", "aqueous_yield": "a_y", "gas_yield": "g_y",
    "oil_hhv": "e_b", "char_hhv": "e_h", "oil_c": "c_b", "char_c": "c_h",
}

# --- fixed values: atomic weights ----------------------------------------------------
ATOMIC_WEIGHTS = {"c": 12.011, "h": 1.008, "o": 15.999, "n": 14.007, "s": 32.06}
ATOMIC_WEIGHTS_ROUNDED = {"c": 12.01, "h": 1.008, "o": 16.00}

# --- fixed values: logit clipping, temperature bins, small-sample weight -------------
LOGIT_EPS = 1e-3
TEMPERATURE_EDGES = [0.0, 250.0, 300.0, 350.0, 1000.0]
SMALL_SAMPLE = (600, 1.5)

# --- fixed values: overview panels (key, columns, clip quantiles) ---------------------
OVERVIEW_PANELS = [
    ("A_feedstock",
     ["c", "h", "n", "o", "s", "ash", "lignin", "cellulose", "hemicellulose"], (0.01, 0.99)),
    ("B_conditions", ["ic", "temp_c", "t_min", "pressure_effective_mpa"], (0.05, 0.95)),
    ("C_yields", ["b_y", "a_y", "g_y", "c_y"], None),
    ("D_biooil",
     ["c_biooil", "h_biooil", "n_biooil", "o_biooil", "s_biooil", "hhv_biooil"], (0.01, 0.99)),
    ("E_biochar",
     ["c_biochar", "h_biochar", "n_biochar", "o_biochar", "s_biochar", "hhv_biochar"],
     (0.01, 0.99)),
]

# --- fixed values: default envelopes by process (upper ends; lower ends are 0 but one) --
ENERGY_ENVELOPES = {
    "liquefaction": {"e_b": 25.0, "e_h": 8.0, "c_b": 0.55, "c_h": 0.25},
    "carbonization": {"e_b": 3.0, "e_h": 22.0, "c_b": 0.10, "c_h": 0.65},
    "pyrolysis": {"e_b": 22.0, "e_h": 18.0, "c_b": 0.60, "c_h": 0.60},
    "other": {"e_b": 25.0, "e_h": 22.0, "c_b": 0.60, "c_h": 0.60},
}
YIELD_ENVELOPES = {
    "liquefaction": {"b_y": 65.0, "c_y": 35.0, "a_y": 80.0, "g_y": 30.0},
    "carbonization": {"b_y": 15.0, "c_y": 90.0, "a_y": 60.0, "g_y": 30.0},
    "pyrolysis": {"b_y": 75.0, "c_y": 50.0, "a_y": 15.0, "g_y": 40.0},
    "other": {"b_y": 80.0, "c_y": 90.0, "a_y": 80.0, "g_y": 50.0},
}
ENVELOPE_LOWER = {("carbonization", "c_y"): 20.0}
# (class, text contained, text equal), first match wins; yields use a shorter stem
ENERGY_PROCESS_RULES = [
    ("liquefaction", ["hydrothermal liquefaction", "liquefaction"], "htl"),
    ("carbonization", ["hydrothermal carbon", "carbonization"], "htc"),
    ("pyrolysis", ["pyrolysis"], None),
]
YIELD_PROCESS_RULES = [
    ("liquefaction", ["hydrothermal liq", "liquefaction"], "htl"),
    ("carbonization", ["hydrothermal carbon", "carbonization"], "htc"),
    ("pyrolysis", ["pyrolysis"], None),
]
ENERGY_CAP_SLACK = 0.05
YIELD_CAP_SLACK = 0.02
MASS_BALANCE_RANGE = (98.0, 102.0)

# --- fixed values: quality rules (name, column, lowest allowed, highest allowed) ---------
QUALITY_RULES = [
    ("e_h_high", "e_h", None, 25.0),
    ("e_b_high", "e_b", None, 25.0),
    ("b_y_range", "b_y", 0.0, 100.0),
    ("c_y_range", "c_y", 0.0, 100.0),
    ("c_b_high", "c_b", None, 0.60),
    ("c_h_high", "c_h", None, 0.65),
    ("hhv_input_low", "hhv_input", 12.0, None),
    ("h_c_range", "h_c", 0.8, 1.9),
    ("o_c_range", "o_c", 0.35, 0.95),
]

# --- fixed values: target dimension ---------------------------------------------------
TARGET_LABELS = {
    "b_y": ("% w/w", "Bio-oil yield"),
    "c_y": ("% w/w", "Char yield"),
    "a_y": ("% w/w", "Aqueous / other yield"),
    "g_y": ("% w/w", "Gas yield"),
    "gw_y": ("% w/w", "Gas + water yield"),
    "e_b": ("%", "Bio-oil energy yield"),
    "e_h": ("%", "Char energy yield"),
    "c_b": ("%", "Bio-oil carbon yield"),
    "c_h": ("%", "Char carbon yield"),
    "hhv_biooil": ("MJ/kg", "Bio-oil HHV"),
    "hhv_biochar": ("MJ/kg", "Biochar HHV"),
    "o_c_biooil": ("mol/mol", "O/C (bio-oil)"),
    "h_c_biooil": ("mol/mol", "H/C (bio-oil)"),
    "o_c_biochar": ("mol/mol", "O/C (biochar)"),
    "h_c_biochar": ("mol/mol", "H/C (biochar)"),
}
ELEMENT_NAMES = {"c": "Carbon", "h": "Hydrogen", "o": "Oxygen", "n": "Nitrogen", "s": "Sulfur"}
PHASE_NAMES = {"biooil": "bio-oil", "biochar": "biochar"}

# --- fixed values: model defaults and search lists -------------------------------------
FOREST_DEFAULTS = {
    "numTrees": 800, "maxDepth": 30, "featureSubsetStrategy": "sqrt",
    "minInstancesPerNode": 5, "subsamplingRate": 0.9, "seed": 42,
}
TREE_DEFAULTS = {"maxDepth": 30, "minInstancesPerNode": 1, "seed": 42}
BOOSTED_DEFAULTS = {
    "maxIter": 600, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42,
    "featureSubsetStrategy": "0.8",
}
SEARCH_LISTS = {
    "numTrees": [400, 800],
    "maxDepth": [20, 30],
    "minInstancesPerNode": [1, 2],
    "featureSubsetStrategy": ["sqrt", "0.5"],
    "subsamplingRate": [0.8],
}
SEARCH_DRAWS = 6
LIGHT_TUNING_CANDIDATES = [
    {},
    {"maxDepth": 30, "minInstancesPerNode": 1},
    {"maxDepth": 30, "minInstancesPerNode": 2},
    {"maxDepth": 30, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"},
]
LIGHT_TUNING_ROWS = 800
MIN_TRAIN_ROWS = 30
