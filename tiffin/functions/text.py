"""Text functions: matching, cleaning and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiffin.functions import domains


def contains_ci(text: Column, term: str | Column) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` are ordinary characters."""
    needle = F.lit(term) if isinstance(term, str) else term
    return F.contains(F.lower(text), F.lower(needle))


def present(text: Column) -> Column:
    """The text, or NULL where it is empty."""
    return F.nullif(text, F.lit(""))


# White space at either end, of any script.
_ENDS = r"^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_ENDS = _ENDS + "|" + _ENDS[1:] + "$"

# What the parts of a mail address may be made of: atoms of the local part, joined by single
# dots; labels of the host that neither begin nor end with a hyphen; a last label of letters.
_LETTERS = r"a-zA-Z\x{A1}-\x{FFFF}"
_ATOM = rf"[{_LETTERS}0-9!#$%&'*+/=?^_`{{|}}~-]+"
_LABEL = rf"[{_LETTERS}0-9]([{_LETTERS}0-9-]{{0,61}}[{_LETTERS}0-9])?"
_EMAIL = rf"^(?=.{{1,64}}@.{{1,254}}$){_ATOM}(\.{_ATOM})*@({_LABEL}\.)+([{_LETTERS}]{{2,63}}|xn--[a-zA-Z0-9-]{{1,59}})$"


def trimmed(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, _ENDS, "")


def clean_email(text: Column) -> Column:
    return F.lower(trimmed(text))


def is_username(text: Column) -> Column:
    return text.rlike(domains.USERNAME_PATTERN)


def is_phone(text: Column) -> Column:
    return text.rlike(domains.PHONE_PATTERN)


def is_email(text: Column) -> Column:
    return text.rlike(_EMAIL)


def name_key(text: Column) -> Column:
    """Account names compare without case, accents or trailing spaces."""
    return F.collate(text, domains.NAME_COLLATION)


def plain_name_key(text: Column) -> Column:
    """``name_key`` of a text of printable ASCII as an ordinary string, which Spark hashes and compares by its bytes;
    NULL for any other text."""
    return F.when(~text.rlike("[^ -~]"), F.lower(F.rtrim(text)))


def display_name(full_name: Column, username: Column, user_id: Column) -> Column:
    return F.coalesce(
        present(full_name), present(username), F.concat(F.lit("User #"), user_id.cast("string"))
    )


def item_label(name: Column, item_id: Column) -> Column:
    return F.coalesce(present(name), F.format_string(domains.ITEM_NOT_FOUND, item_id))


def upper_or(text: Column, default: str) -> Column:
    """Upper-cased text; ``default`` (upper-cased too) where it is missing or empty."""
    return F.upper(F.coalesce(present(text), F.lit(default)))


def status_bucket(status: Column) -> Column:
    """Severity of an order or payment status."""
    return (
        F.when(status == "pending", "waiting")
        .when(status.isin("confirmed", "preparing", "ready"), "active")
        .when(status.isin("completed", "paid"), "done")
        .when(status.isin("cancelled", "refunded"), "failed")
        .otherwise("other")
    )


def log_level(status_code: Column) -> Column:
    return F.when(status_code >= 400, "ERROR").otherwise("INFO")
