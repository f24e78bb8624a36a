from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.oracle import session  # noqa: E402

PRICE_DDL = (
    "company_id bigint, ticker string, ts bigint, value double, interval bigint, "
    "valueUnit string, pos bigint"
)


@pytest.fixture(scope="session")
def spark():
    active = session("4")
    yield active
    active.stop()


@pytest.fixture
def prices(spark):
    """Build a price table from ``{ticker: [value, …]}``; times ascend by day."""

    def build(series: dict, timed: bool = True):
        rows = [
            (1, t, i * 86_400_000 if timed else None, v, 0, "USD", i)
            for t, values in series.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, PRICE_DDL)

    return build


@pytest.fixture
def write(tmp_path):
    """Write a text file and return its path."""

    def put(name: str, text: str) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    return put


NOVA = json.dumps(
    {
        "id": 1, "name": "Nova Tidal Works", "ticker": "NOVA", "sector": "Energy", "industry": "Tidal Power",
        "description": "Invented for tests", "indices": ["NORTH30"], "exchanges": ["OSL"],
        "aggregations": {"pe": 17, "market_cap": 730000000, "rating": "BBB+"},
        "insights": {"stock_price": [{"date": f"2021-06-0{day}", "value": value} for day, value in enumerate((80, 84, 63, 70, 77), 1)]},
        "lastUpdated": {"fundamentals": "2021-06-05", "stock_price": "2021-06-06"},
    },
    separators=(",", ":"),
)
QRTZ = json.dumps(
    {
        "id": 2, "name": "Quartz & Daughters", "ticker": "QRTZ", "sector": "Materials", "industry": "Glass",
        "description": "Invented as well", "indices": [], "exchanges": ["VIE", "BER"],
        "aggregations": {"pe": 9, "market_cap": 41000000},
        "insights": {"stock_price": [{"date": f"2022-02-1{day}", "value": value} for day, value in enumerate((12, 15, 9))]},
        "lastUpdated": {"fundamentals": "2022-02-12", "stock_price": "2022-02-13"},
    },
    separators=(",", ":"),
)


@pytest.fixture
def sample_lines(write):
    return write("companies.ndjson", NOVA + "\n" + QRTZ + "\n")


@pytest.fixture
def sample_companies(spark, sample_lines):
    from marketframe.operators.shaping import typed_companies
    from marketframe.sources import read_companies

    return typed_companies(read_companies(spark, sample_lines, lines=True))
