"""Fixed values of the catalogue and inventory model (names a stored row or a result may carry)."""

from __future__ import annotations

# Order in which vehicle attributes are reported and asked.
ATTRIBUTE_ORDER = (
    "make",
    "model",
    "chassis_code",
    "year",
    "facelift",
    "trim_line",
    "parktronic_sensors",
    "headlamp_washer",
    "front_camera",
)
IDENTITY_ATTRIBUTES = ("make", "model", "chassis_code")
TEXT_CONDITIONS = ("trim_line",)
INT_CONDITIONS = ("parktronic_sensors",)
BOOL_CONDITIONS = ("headlamp_washer", "front_camera")
CONDITIONS = TEXT_CONDITIONS + INT_CONDITIONS + BOOL_CONDITIONS

# Kinds of fitment evidence.
QUALIFYING_EVIDENCE = ("oem_catalog", "manufacturer_doc", "owner_confirmed")
NON_EVIDENCE = (
    "visual_similarity",
    "customer_statement",
    "llm_output",
    "listing_title",
    "body_code_only",
)
SYNTHETIC_EVIDENCE = "synthetic_fixture"
EVIDENCE_TYPES = (*QUALIFYING_EVIDENCE, SYNTHETIC_EVIDENCE, *NON_EVIDENCE)

# Allowed words of the stored columns.
DATA_ORIGINS = ("real", "synthetic")
PRODUCT_CONDITIONS = ("new", "used")
SET_KINDS = ("single", "virtual_set", "stocked_set")
FITMENT_STATUSES = ("verified", "needs_verification", "incompatible")
SYNTHETIC_SKU_PREFIX = "SYN-"
