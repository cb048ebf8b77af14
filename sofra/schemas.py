"""Table schemas of the menu domain, and the order of its enumerations (by rank, not by alphabet)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLES = {
    "cities": "id int, name string, slug string",
    "dishes": "id int, name string, category string, parent_id int, is_celiac boolean, is_vegan boolean, is_vegetarian boolean, estimated_calories int",
    "dish_aliases": "id int, name string, dish_id int",
    "menus": "id int, city_id int, serve_date date, meal_type string, status string, source_type string, merkle_root string, previous_hash string, calorie_range_min int, calorie_range_max int, created_at timestamp",
    "menu_dishes": "id int, menu_id int, dish_alias_id int, order_index int, is_alternative boolean, package_name string, amount string, calories int",
    "menu_history": "id int, city_id int, serve_date date, meal_type string, source_type string, dishes_payload string, created_at timestamp",
    "pricing_periods": "id int, city_slug string, period_start date, period_end date",
    "meal_category_prices": "pricing_period_id int, meal_type string, category_name string, portion_amount string, price decimal(10,2)",
    "menu_votes": "id int, menu_id int, user_id string, sentiment string, created_at timestamp",
    "dish_votes": "id int, dish_id int, menu_id int, user_id string, sentiment string, is_explicit boolean, created_at timestamp",
    "comments": "id string, user_id string, menu_id int, dish_id int, parent_id string, content string, sentiment string, is_deleted boolean, created_at timestamp, updated_at timestamp",
    "vote_reactions": "id int, user_id string, comment_id string, reaction_type string, created_at timestamp",
    "user_blocks": "blocker_id string, blocked_id string",
    "users": "id string, username string, avatar_url string, karma_score int, opt_out_statistics boolean",
    "reports": "id int, reporter_id string, comment_id string, reason string, status string, created_at timestamp",
    "user_warnings": "id int, message string, created_at timestamp",
    "tags": "id int, name string, category string",
    "dish_tags": "dish_id int, tag_id int, created_at timestamp",
    "api_usage_logs": "api_key_id string, date date, requests int, errors int",
    "system_incidents": "id int, component string, status string, impact string, created_at timestamp, resolved_at timestamp",
    "push_subscriptions": "id int, endpoint string, city_id int, notif_breakfast_enabled boolean, notif_dinner_enabled boolean, notif_breakfast_time string, notif_dinner_time string",
    "badges": "id int, name string, description string",
    "user_badges": "user_id string, badge_id int, earned_at timestamp",
}

ENUMS = {
    "meal_type": ("breakfast", "lunch", "dinner"),
    "menu_status": ("pending", "approved", "rejected"),
    "sentiment": ("positive", "negative", "neutral"),
    "reaction_type": ("upvote", "downvote"),
    "report_status": ("pending", "resolved", "dismissed"),
}


def rank(enum: str, column: Column | str) -> Column:
    """Sort key of an enumeration: the place of the value, null for others."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("int")
    for i, v in enumerate(ENUMS[enum]):
        out = F.when(c == v, i).otherwise(out)
    return out
