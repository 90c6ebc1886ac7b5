"""Shared fixtures: one local session, the seeded unit-test frame, small tables."""

from __future__ import annotations

import os
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import get_session  # noqa: E402
from ledgerlens.spec import REFERENCE_SPEC  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4, driver_memory="4g")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-test-ckpt-"))
    yield s


def make_sales(n: int = 1500, seed: int = 7) -> pd.DataFrame:
    """Seeded fact frame with the canonical columns: label = volume >= 7000,
    row 0 = 7000 and row 1 = 6999 as sentinels; features independent of the target."""
    rng = np.random.default_rng(seed)
    vol = rng.integers(100, 9999, n)
    vol[0], vol[1] = 7000, 6999
    df = pd.DataFrame({
        "Model": rng.choice(["X5", "M5", "3 Series", "i8"], n),
        "Year": rng.integers(2010, 2025, n).astype("int16"),
        "Region": rng.choice(["Europe", "Asia", "Africa"], n),
        "Color": rng.choice(["Black", "White", "Red"], n),
        "Fuel_Type": rng.choice(["Petrol", "Diesel", "Hybrid", "Electric"], n),
        "Transmission": rng.choice(["Manual", "Automatic"], n),
        "Engine_Size_L": np.round(rng.uniform(1.5, 5.0, n), 1).astype("float32"),
        "Mileage_KM": rng.integers(3, 200_000, n).astype("int32"),
        "Price_USD": rng.integers(30_000, 120_000, n).astype("int32"),
        "Sales_Volume": vol.astype("int32"),
    })
    df["Sales_Classification"] = np.where(df["Sales_Volume"] >= 7000, "High", "Low")
    return df


@pytest.fixture(scope="session")
def sample_pdf() -> pd.DataFrame:
    return make_sales()


@pytest.fixture(scope="session")
def sample_sales(spark, sample_pdf):
    import hashlib

    pdf = sample_pdf.copy()
    pdf["row_key"] = [hashlib.md5(str(i).encode()).hexdigest() for i in range(len(pdf))]
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="session")
def spec():
    return REFERENCE_SPEC
