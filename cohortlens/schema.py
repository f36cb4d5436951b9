"""Column names and fixed lookup values of the measure table."""

from __future__ import annotations

ID = "person_id"
ORG = "org_id_provider"
DATES = ["first_contact", "last_contact", "care_mid_date"]

# The 11 clustering measures, in the order the analysis uses them.
MEASURES = [
    "care_contacts",
    "referrals",
    "length_care",
    "average_daily_contacts",
    "contact_prop_aft_midpoint",
    "team_input_count",
    "intermittent_care_periods",
    "specialist_contact_prop",
    "remote_contact_prop",
    "avg_contact_duration",
    "acute_admissions_2223",
]

# Measures that arrive as text in the raw extract and need a lenient cast.
TEXT_MEASURES = [
    "team_input_count",
    "intermittent_care_periods",
    "avg_contact_duration",
    "acute_admissions_2223",
]

# Missing means "none": replaced by 0 before anything else.
ZERO_FILL = ["intermittent_care_periods", "acute_admissions_2223"]

# --- Fixed values: display labels of the measures (variable, variable_clean).
MEASURE_LABELS = [
    ("person_id", "0. Person ID"),
    ("care_contacts", "A. Care contacts"),
    ("referrals", "B. Referrals"),
    ("length_care", "C. Care length"),
    ("average_daily_contacts", "D. Average daily contacts"),
    ("contact_prop_aft_midpoint", "E. Contact proportion after midpoint"),
    ("team_input_count", "F. Team input count"),
    ("intermittent_care_periods", "G. Intermittent care periods"),
    ("specialist_contact_prop", "H. Specialist care proportion"),
    ("remote_contact_prop", "I. Remote care proportion"),
    ("avg_contact_duration", "J. Average contact duration"),
    ("acute_admissions_2223", "K. Acute admission count"),
]

# --- Fixed values: Gaussian mixture covariance models (model, model_name).
MODEL_NAMES = [
    ("EII", "spherical, equal volume"),
    ("VII", "spherical, unequal volume"),
    ("EEI", "diagonal, equal volume and shape"),
    ("VEI", "diagonal, varying volume, equal shape"),
    ("EVI", "diagonal, equal volume, varying shape"),
    ("VVI", "diagonal, varying volume and shape"),
    ("EEE", "ellipsoidal, equal volume, shape, and orientation"),
    ("VEE", "ellipsoidal, equal shape and orientation"),
    ("EVE", "ellipsoidal, equal volume and orientation"),
    ("VVE", "ellipsoidal, equal orientation"),
    ("EEV", "ellipsoidal, equal volume and equal shape"),
    ("VEV", "ellipsoidal, equal shape"),
    ("EVV", "ellipsoidal, equal volume"),
    ("VVV", "ellipsoidal, varying volume, shape, and orientation"),
    ("X", "univariate normal"),
    ("XII", "spherical multivariate normal"),
    ("XXI", "diagonal multivariate normal"),
    ("XXX", "ellipsoidal multivariate normal"),
]

# The 14 multivariate covariance models searched by the BIC grid.
GRID_MODELS = [m for m, _ in MODEL_NAMES[:14]]

# --- Fixed values: analysis settings of the original study.
OUTLIER_QUANTILE = 0.99
DBSCAN_EPS = 1.8
DBSCAN_MIN_PTS = 5
EVAL_FRACTION = 0.25
EVAL_SEED = 123
KMEANS_KS = list(range(4, 13))
# starts and greatest number of updates of the final fit of each k
KMEANS_SETTINGS = {4: (100, 100), 5: (100, 100), 6: (10, 1000), 7: (100, 1000), 8: (100, 100), 9: (100, 100),
                   10: (100, 100), 11: (100, 100), 12: (100, 100)}
ELBOW_MAX_K = 10
ELBOW_SEED = 1234
MIXTURE_GROUPS = list(range(1, 13))
CHOSEN_MIXTURE = ("EEV", 6)
