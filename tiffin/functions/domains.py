"""Values that must be equal to the ordering application's for right results."""

# State and role names.
ORDER_STATUSES = ["pending", "confirmed", "preparing", "ready", "completed", "cancelled"]
PAYMENT_STATUSES = ["pending", "paid", "refunded"]
ROLES = ["customer", "admin"]
ORDER_TYPES = ["asap", "scheduled"]

# Limits.
PAGE_SIZE = 20
MAX_ADMINS = 2
RATE_LIMITS = {  # name -> (requests, window)
    "all": (100, "15 minutes"),
    "sign_in": (10, "15 minutes"),
    "order": (3, "1 minute"),
}

# Declared column lengths.
TEXT_LENGTHS = {
    "users": {"username": 20, "email": 100, "full_name": 100, "phone": 20},
    "categories": {"category_name": 100},
    "menu_items": {"item_name": 100, "image_url": 500},
    "orders": {"order_number": 50, "payment_method": 50},
    "audit_logs": {"action": 100, "entity_type": 50, "ip_address": 45},
}

# Texts shown to users.
NO_DESCRIPTION = "No description available."
ITEM_NOT_FOUND = "Item Not Found (ID: %d)"
ITEM_GONE = 'Item "%s" is no longer available. Please remove it from your cart.'
NOT_CREATED = "Failed to create order"
BUTTON_REMOVED = "Removed"
BUTTON_UNAVAILABLE = "Unavailable"
BUTTON_CUSTOMERS_ONLY = "Customers Only"
BUTTON_ADD = "Add to Cart"

# Messages of broken rules.
MESSAGES = {
    "username_short": "Username must be at least 3 characters",
    "email": "Invalid email address",
    "role": "Invalid role specified",
    "username_length": "Username must be 3-20 characters",
    "username_charset": "Username can only contain letters, numbers, and underscores",
    "email_format": "Invalid email format",
    "full_name": "Full name must be 2-100 characters",
    "phone": "Invalid phone format",
    "item_name": "Item name is required",
    "item_name_length": "Item name must be 1-100 characters",
    "price": "Price is required",
    "price_number": "Price must be a valid number greater than 0",
    "category_id": "Invalid category ID",
    "description": "Description must be less than 500 characters",
    "is_available": "is_available must be a boolean",
    "category_name": "Category name required (1-100 chars)",
    "is_active": "is_active must be boolean",
    "schedule_missing": "Scheduled time is required for scheduled orders.",
    "schedule_past": "Invalid or past scheduled time.",
    "no_items": "Order must contain at least one item",
    "payment_method": "Payment method is required",
    "item_data": "Invalid item data (item ID or quantity missing/invalid).",
    "item_quantity": "Item quantity must be at least 1",
    "cart_payload": "Invalid cart:add payload",
    "cart_item": "Malformed item data",
    "admin_cap": "Admin registration failed: Maximum of %d admin accounts allowed.",
}

# Patterns of accepted input.
USERNAME_PATTERN = "^[a-zA-Z0-9_]+$"
PHONE_PATTERN = r"^[0-9\-+\s]+$"
ACCESS_LOG_PATTERN = r"^\[(INFO|ERROR)\] ([A-Z]+) (\S+) - (\d{3}) - (\d+)ms$"

# Case-, accent- and trailing-space-insensitive comparison of account names.
NAME_COLLATION = "UNICODE_CI_AI_RTRIM"
