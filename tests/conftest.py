import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chronotape.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def splitting(spark):
    """Cut keys over 20 rows into slices, as a cluster does with keys over a million."""
    spark.conf.set("spark.chronotape.splitRows", "20")
    yield spark
    spark.conf.unset("spark.chronotape.splitRows")


@pytest.fixture
def tape(spark):
    """Rows of a hand-made tape: dicts with client, t in days (fractions allowed), type and any field."""
    from chronotape.functions.clock import DAY

    fields = {
        "id": "bigint", "client": "string", "t": "bigint", "type": "string", "source": "string", "operation": "string",
        "status": "string", "reason": "string", "channel": "string", "amount": "bigint", "mcc": "string", "merchant_category": "string",
        "merchant_name": "string", "merchant_country": "string", "merchant_city": "string", "is_online": "boolean",
        "original_currency": "string", "counterparty": "string", "account_id": "string", "balance_after": "bigint",
        "contract_id": "string", "card_id": "string", "product_id": "string", "session_id": "string",
        "device_new": "boolean", "template": "string", "delivered": "boolean", "field_name": "string",
        "old_value": "string", "new_value": "string", "change_source": "string", "days_past_due": "bigint",
        "decline_reason": "string", "note": "string",
    }
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())

    def build(*rows):
        data = []
        for i, row in enumerate(rows):
            full = dict.fromkeys(fields)
            full.update(id=i, client="a", type="app_screen", source="app")
            full.update(row)
            full["t"] = full["t"] if row.get("exact") else int(full["t"] * DAY)
            full.pop("exact", None)
            data.append(tuple(full[n] for n in fields))
        return spark.createDataFrame(data, schema)

    return build
