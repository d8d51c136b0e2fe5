"""Tables of the shop: files, columns, keys."""

from __future__ import annotations

from marketlens.functions.columns import MONEY

# File stem of each table.
FILES = {
    "orders": "orders_dataset",
    "order_items": "order_items_dataset",
    "order_payments": "order_payments_dataset",
    "order_reviews": "order_reviews_dataset",
    "products": "products_dataset",
    "product_cat": "product_category_name_translation",
    "customers": "customers_dataset",
    "sellers": "sellers_dataset",
    "geolocation": "geolocation_dataset",
    "leads_qualified": "marketing_qualified_leads_dataset",
    "leads_closed": "closed_deals_dataset",
}

# Columns the operators rely on. Tables without an entry are loaded as text.
COLUMNS = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "price": MONEY,
        "freight_value": MONEY,
    },
    "order_payments": {
        "order_id": "string",
        "payment_type": "string",
        "payment_value": MONEY,
        "payment_installments": "int",
    },
    "order_reviews": {
        "review_id": "string",
        "order_id": "string",
        "review_score": "int",
        "review_comment_title": "string",
        "review_comment_message": "string",
        "review_creation_date": "timestamp_ntz",
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        "product_name_lenght": "double",
        "product_description_lenght": "double",
        "product_photos_qty": "double",
        "product_weight_g": "double",
        "product_length_cm": "double",
        "product_height_cm": "double",
        "product_width_cm": "double",
    },
    "product_cat": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
    "customers": {
        "customer_id": "string",
        "customer_city": "string",
        "customer_state": "string",
    },
    "geolocation": {
        "geolocation_city": "string",
        "geolocation_state": "string",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
    },
}

# Columns a file may lack; they are null then.
OPTIONAL = {
    "order_items": {"freight_value"},
    "products": {
        "product_name_lenght",
        "product_description_lenght",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    },
}

# The operators count rows instead of distinct keys where a table has one row per key.
UNIQUE_KEYS = {
    "orders": "order_id",
    "customers": "customer_id",
    "products": "product_id",
    "product_cat": "product_category_name",
}

# Cell texts that mean "missing".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
