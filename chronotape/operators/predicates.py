"""Row predicates over the typed tape. A null comparison counts as false."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operations every rule below refers to.
ALWAYS_ACTIONS = (
    "app_screen", "app_operation", "p2p_out", "cash_withdrawal",
    "early_repayment", "application_submitted", "banner_clicked", "case_opened",
)
OWN_ACCOUNT = "Own account"
OBLIGATION_TOPUPS = ("payment_topup", "card_statement")
CLIENT_BLOCKS = ("client_freeze", "lost_or_stolen")
CLIENT_UNBLOCKS = ("client_request",)
LOGIN_OPERATIONS = ("login", "biometry_login")
INCOME_TYPES = ("salary_credit", "pension_credit", "other_income_credit")
EVERYDAY_TYPES = (
    "purchase", "transfer_out", "p2p_out", "cash_withdrawal", "cash_deposit", "bill_payment",
    "salary_credit", "pension_credit", "other_income_credit", "transfer_in", "p2p_in",
)
HOME_COUNTRY = "KZ"
HOME_CURRENCY = "KZT"


def sure(condition: Column) -> Column:
    """Null becomes false, also under a later negation."""
    return F.coalesce(condition, F.lit(False))


def kind(*names: str) -> Column:
    return sure(F.col("type").isin(*names))


def is_client_action(columns: set[str]) -> Column:
    """Started by the client. `columns` are those of the tape: absent fields are null."""

    def field(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    own = sure(field("counterparty") == OWN_ACCOUNT)
    reason = field("reason")
    debit = sure(field("direction") == "debit")
    rules = [
        kind(*ALWAYS_ACTIONS),
        kind("transfer_out") & ~(sure(reason == "transfer") & own),
        kind("transfer_in") & sure(reason == "transfer") & own,
        kind("purchase") & sure(reason == "purchase"),
        kind("cash_deposit") & ~sure(reason.isin(*OBLIGATION_TOPUPS)),
        kind("bill_payment") & sure(field("channel") != "system"),
        kind("deposit_topup") & debit,
        kind("deposit_withdrawal") & sure(reason == "early_closure") & debit,
        kind("card_blocked") & sure(reason.isin(*CLIENT_BLOCKS)),
        kind("card_unblocked") & sure(reason.isin(*CLIENT_UNBLOCKS)),
        kind("product_closed") & sure(reason == "early_closure"),
        kind("product_migrated") & sure(field("migration_reason") == "successor_offer"),
        kind("profile_change") & sure(field("change_source") == "client"),
    ]
    found = rules[0]
    for rule in rules[1:]:
        found = found | rule
    return found


def is_login() -> Column:
    return kind("app_operation") & sure(F.col("operation").isin(*LOGIN_OPERATIONS))


def is_visit() -> Column:
    """A successful login."""
    return is_login() & sure(F.col("status") == "success")


def is_target_action(columns: set[str]) -> Column:
    """An action, or a product opened on the client's own application."""
    opened = kind("product_opened") & sure(F.col("reason") == "application_approved")
    return is_client_action(columns) | opened


def is_purchase() -> Column:
    return kind("purchase") & sure(F.col("reason") == "purchase")


def is_operation() -> Column:
    """Purchases and outgoing transfers: the rows that are scored."""
    return is_purchase() | kind("transfer_out")


def is_foreign() -> Column:
    return sure(F.col("merchant_country") != HOME_COUNTRY)


def can_be_target(start: int, end: int) -> Column:
    """Inside [start, end), neither a profile change nor the source of a milestone."""
    inside = (F.col("t") >= start) & (F.col("t") < end)
    return sure(inside) & ~kind("profile_change") & F.col("milestone").isNull()
