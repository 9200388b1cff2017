"""Table operators: each takes DataFrames and returns a lazy DataFrame."""

TENANT = ["restaurant_id"]
SERIES = ["restaurant_id", "item_id", "service_period"]
KEY = ["restaurant_id", "business_date", "item_id", "service_period"]
