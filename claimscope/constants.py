"""Fixed values the reports depend on: labels, thresholds, codes and years.

Everything in this module must equal the published results' vocabulary, so it is
kept as plain text in one place. Reports take these as parameter defaults.
"""

# --- fixed values: years ----------------------------------------------------
FIRST_LAND_YEAR = 1985
LAST_LAND_YEAR = 2023
BASE_YEAR = 2020
SPRAWL_YEARS = (2001, 2011)
SPRAWL_BEFORE = (1990, 2000)
SPRAWL_AFTER = (2012, 2022)

# --- fixed values: thresholds -----------------------------------------------
SEVERE_DEPTH_INCHES = 12
MAJOR_STORM_CLAIMS = 500
STORM_GROUP_CLAIMS = 100
SEVERITY_GROUP_CLAIMS = 500
SPRAWL_GROWTH = "0.05"
SPRAWL_BASELINE_CLAIMS = 10
EXACT_ZIP_MATCH = "Zip matches ZCTA"

# --- fixed values: cause-of-damage codes and their labels -------------------
RIVER_CODE = "2"
RAIN_CODE = "4"
RIVER_LABEL = "River/Stream Overflow"
RAIN_LABEL = "Flash Flood (Rain Accumulation)"

# --- fixed values: event names too generic to identify one storm ------------
GENERIC_EVENT_NAMES = (
    "Flooding",
    "Storm",
    "Not a named storm",
    "Thunderstorms",
    "Severe flooding",
    "Torrential rain",
    "Severe Storms and Flooding",
)

# --- fixed values: land-cover classes, in file order ------------------------
LAND_CLASSES = (
    "OPENWATER",
    "PER_ICESNOW",
    "DEV_OPENSPACE",
    "DEV_LOWINTENSITY",
    "DEV_MEDINTENSITY",
    "DEV_HIINTENSITY",
    "BARREN",
    "DECIDUOUSFOREST",
    "EVERGREENFOREST",
    "MIXEDFOREST",
    "SHRUBSCRUB",
    "GRASSHERB",
    "PASTUREHAY",
    "CULTCROPS",
    "WOODYWET",
    "HERBWET",
)

DEVELOPED = ("PROP_DEV_LOWINTENSITY", "PROP_DEV_MEDINTENSITY", "PROP_DEV_HIINTENSITY")
DENSE = ("PROP_DEV_MEDINTENSITY", "PROP_DEV_HIINTENSITY")
HIGH_INTENSITY = ("PROP_DEV_HIINTENSITY",)
WETLAND = ("PROP_WOODYWET", "PROP_HERBWET")
NATURAL = ("PROP_WOODYWET", "PROP_HERBWET", "PROP_DECIDUOUSFOREST")
WILDLAND = (
    "PROP_DECIDUOUSFOREST",
    "PROP_EVERGREENFOREST",
    "PROP_MIXEDFOREST",
    "PROP_SHRUBSCRUB",
)
FARMLAND = ("PROP_PASTUREHAY", "PROP_CULTCROPS")

# --- fixed values: archetype labels -----------------------------------------
COST_LABELS = (
    "Highly Developed (>50%)",
    "Highly Natural/Wetland (>50%)",
    "Mixed/Other",
)
FLOOD_TYPE_LABELS = ("High Concrete", "High Natural", "Mixed")
STORM_LABELS = (
    "1. Wetland Buffer (High Absorption)",
    "2. Dense Urban (Concrete Shield)",
    "3. Suburban Sprawl",
    "4. Forest/Wildland (Natural Sponge)",
    "5. Agricultural/Rural (Moderate Runoff)",
    "6. Mixed/Transition Zone",
)
SEVERITY_LABELS = (
    "1. Concrete Jungle (High Intensity)",
    "2. Suburban Sprawl",
    "3. Swamp/Wetland",
    "4. Forest/Wildland (Natural Sponge)",
    "5. Mixed/Transition Zone",
)

# --- fixed values: density bands over the decile bucket ---------------------
LOW_BAND_MAX = 30
MEDIUM_BAND_MAX = 60
BAND_LABELS = ("Low (0-30%)", "Medium (40-60%)", "High (70-100%)")

# --- fixed values: number of decimals kept by each kind of quotient ---------
RATE_DIGITS = 4
RATIO_DIGITS = 7
REAL_DIGITS = 9
