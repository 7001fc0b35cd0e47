"""Fixed schemas and vocabularies of the retail data model.

Every table gets an explicit ``StructType``; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values that must equal the reference's --------------------------
# Event names accepted by the session-state validator, in reference order.
SESSION_EVENTS = ["heartbeat", "search", "view-product", "add-to-cart", "exit-risk"]
# All client event names (the validator list plus view-cart).
CLIENT_EVENTS = ["heartbeat", "view-product", "add-to-cart", "exit-risk", "search", "view-cart"]
# Client-side required metadata fields per event (must all be truthy).
REQUIRED_FIELDS = {
    "heartbeat": [],
    "view-product": ["productId", "subCategory", "brand"],
    "add-to-cart": ["productId", "subCategory", "brand"],
    "exit-risk": ["exitMethod"],
    "search": ["query", "productId", "subCategory", "articleType", "brand"],
    "view-cart": [],
}
# Intent weights: search 1, view-product 3, add-to-cart 7, everything else 0.
EVENT_WEIGHTS = {"search": 1, "view-product": 3, "add-to-cart": 7}
# Signal names.
SIGNALS = ["exit-risk", "high-intent", "search-friction", "cart-abandonment"]
# Signal -> next-best-action type.
SIGNAL_TO_ACTION = {
    "search-friction": "discount-product-recommendation",
    "high-intent": "social-proof-notification",
    "exit-risk": "shipping-discount",
    "cart-abandonment": "cart-rescue",
}
# Offer ladders (baseline by severity, one rung up for Medium churn risk).
EXIT_OFFERS = {"low": "15% off your order", "medium": "20% off your order",
               "high": "25% off your order", "urgent": "30% off your order"}
EXIT_LADDER = ["15% off your order", "20% off your order",
               "25% off your order", "30% off your order"]
CART_OFFERS = {"low": "10% off your order", "medium": "15% off your order",
               "high": "20% off your order"}
CART_LADDER = ["10% off your order", "15% off your order",
               "20% off your order", "25% off your order"]
HIGH_RISK_OFFER = "FREE shipping and 25% off your order"
# Churn features, in model order.
FEATURE_COLUMNS = [
    "total_signals", "exit_risk_count", "search_friction_count",
    "high_intent_count", "session_count", "total_nbas",
    "redeemed_count", "exit_risk_ratio", "engagement_rate",
    "signals_per_session",
]
# Risk tiers, right-closed: (-0.01,0.3] Low, (0.3,0.6] Medium, (0.6,1.01] High.
TIER_EDGES = (0.3, 0.6)
TIER_LABELS = ["Low", "Medium", "High"]
# Order shipping methods and their status steps.
HOME_LABEL = "Buy Online, Get Delivery at Home"
BOPIS_LABEL = "Buy Online, Pick up in Store"
HOME_STEPS = ["In Process", "Ready for delivery", "Picked up from warehouse",
              "In Transit", "Delivered"]
BOPIS_STEPS = ["In Process", "Ready for pickup", "Customer In Store", "Completed"]
UNKNOWN_ADDRESS = "Unknown address"
PAGE_SIZE = 20
# Evidence sentences of the signals; {window} is "in the last <window>", %d a count.
EVIDENCE = {
    "exit-risk": {
        "high": "Strong exit intent detected {window}.",
        "medium": "Repeated exit signals detected {window}.",
        "low": "Early exit signals detected {window}.",
    },
    "cart-abandonment": "Customer is dwelling on a cart with %d item(s) and has not checked out {window}.",
    "search-friction": {
        "high": "Explored many products (%d) {window} with no add-to-cart, suggesting "
                "scattered attention and difficulty converging.",
        "medium": "Explored several products (%d) {window} with no add-to-cart, "
                  "suggesting choice overload.",
        "low": "Explored a few products (%d) {window} with no add-to-cart, "
               "suggesting early search friction.",
    },
    "high-intent": "add-to-cart occurred for product {window}",
}
VECTOR_LIMIT = 60
# --------------------------------------------------------------------------

TAGS = T.StructType([
    T.StructField("userId", T.StringType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("event", T.StringType()),
])

METADATA = T.StructType([
    T.StructField("productId", T.StringType()),
    T.StructField("articleType", T.StringType()),
    T.StructField("subCategory", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("itemCount", T.IntegerType()),
    T.StructField("exitMethod", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("tags", TAGS),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("metadata", METADATA),
])

TOPIC = T.StructType([
    T.StructField("dimension", T.StringType()),
    T.StructField("value", T.StringType()),
])

SIGNAL = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("uid", T.StringType()),
    T.StructField("signal", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("productId", T.StringType()),
    T.StructField("distinctProducts", T.IntegerType()),
    T.StructField("topic", TOPIC),
])

SCORES = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("churn_probability", T.DoubleType()),
    T.StructField("churn_risk_tier", T.StringType()),
    T.StructField("scored_at", T.TimestampType()),
    T.StructField("top_risk_factor", T.StringType()),
    T.StructField("total_signals", T.LongType()),
    T.StructField("engagement_rate", T.DoubleType()),
])

PRICE = T.StructType([
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
])

LINE = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("amount", T.IntegerType()),
    T.StructField("price", PRICE),
])

STATUS = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])

ORDER = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("shipping_address", T.StringType()),
    T.StructField("products", T.ArrayType(LINE)),
    T.StructField("status_history", T.ArrayType(STATUS)),
])

CART_EDIT = T.StructType([
    T.StructField("user", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),          # push | pull | clear
    T.StructField("product", LINE),
])
