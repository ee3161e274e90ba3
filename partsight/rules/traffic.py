"""Fixed values of the marketplace API: rates, endpoints, error classes, reply classes."""

from __future__ import annotations

# Requests per minute and burst per endpoint.
RATE_LIMITS = {
    "token": (6, 2),
    "accounts_self": (30, 2),
    "chats_list": (30, 3),
    "chat_detail": (30, 3),
    "messages_list": (30, 3),
    "voice_files": (10, 1),
    "items_list": (25, 5),
    "item_detail": (500, 10),
    "send_text": (20, 1),
}
BULK_SHARE = 0.5
MAX_RETRY_AFTER_S = 900
DEFAULT_429_COOLDOWN_S = 60
PAGE_LIMIT = (1, 99)
OFFSET_MAX = 1000

# Fixed values: (endpoint, method, path template).
ENDPOINTS = (
    ("token", "POST", "/token"),
    ("accounts_self", "GET", "/core/v1/accounts/self"),
    ("chats_list", "GET", "/messenger/v2/accounts/{user_id}/chats"),
    ("chat_detail", "GET", "/messenger/v2/accounts/{user_id}/chats/{chat_id}"),
    ("messages_list", "GET", "/messenger/v3/accounts/{user_id}/chats/{chat_id}/messages/"),
    ("voice_files", "GET", "/messenger/v1/accounts/{user_id}/getVoiceFiles"),
    ("items_list", "GET", "/core/v1/items"),
    ("item_detail", "GET", "/core/v1/accounts/{user_id}/items/{item_id}/"),
)

# What a caller does after an error kind.
RETRY_CLASS = {
    "auth": "auth",
    "rate_limited": "rate_limited",
    "client": "permanent",
    "server": "retryable_read",
    "timeout": "retryable_read",
    "network": "retryable_read",
    "unexpected_payload": "permanent",
}

# Replies that settle a send as not delivered; transport failures and their reading.
DEFINITE_REJECTIONS = (400, 401, 403, 404, 422, 429)
TRANSPORT_OUTCOMES = {
    "connect_error": ("not_delivered", "not_sent_connect"),
    "connect_timeout": ("not_delivered", "not_sent_connect"),
    "pool_timeout": ("not_delivered", "not_sent_connect"),
    "unsupported_protocol": ("not_delivered", "not_sent_connect"),
    "local_protocol_error": ("not_delivered", "not_sent_connect"),
    "read_timeout": ("unknown", "timeout_after_send"),
    "read_error": ("unknown", "connection_lost_after_send"),
    "remote_protocol_error": ("unknown", "connection_lost_after_send"),
    "close_error": ("unknown", "connection_lost_after_send"),
    "write_timeout": ("unknown", "write_incomplete"),
    "write_error": ("unknown", "write_incomplete"),
}
