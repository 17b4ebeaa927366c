"""Values every result depends on, kept in one place."""

# ---------------------------------------------------------------------------
# Results only match when these stay exactly as written.
# ---------------------------------------------------------------------------
DEGREES_PER_RADIAN = 57.2958
EARTH_RADIUS_MILES = 3958.75
PRICE_PER_MILE = 0.032
BASE_PRICE = 230

# id, display name, fee, seats
CABIN_CLASSES = [
    (1, "Economy", "0.00", 48),
    (2, "Economy Comfort", "59.00", 8),
    (3, "Business", "99.00", 8),
    (4, "First", "199.00", 4),
]

DEFAULT_ORIGIN = "ORD"
DEFAULT_DESTINATION = "ATL"
DEFAULT_AIRLINE = "DL"
DEFAULT_CLASS_ID = 1
DEFAULT_MAX_LEGS = 3
MAX_LEGS = 3
CONNECTION_WAIT_MINUTES = 120
FORM_DATE_FORMAT = "M/d/yyyy"
CARD_LABEL_PREFIX = "Visa "
# ---------------------------------------------------------------------------

MONEY = "decimal(19,2)"
