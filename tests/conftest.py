import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twintable.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "twintable-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def goods(spark):
    """A small product table, 240 rows, with a label that depends on its features."""
    rows = []
    kinds, stuffs, regions = ["cell", "board", "case"], ["steel", "glass", "plastic"], ["NA", "EU", "APAC", "Other"]
    for i in range(240):
        share = (i * 37 % 101) * 0.97
        hazard = 1 if i % 9 == 0 else 0
        label = "Low" if share < 15 or hazard else "High" if share > 70 else "Medium"
        rows.append((kinds[i % 3], stuffs[i * 7 % 5 % 3], 3.0 + (i * 53 % 97), share, regions[i * i % 4], i % 5 and 1, hazard, label))
    return spark.createDataFrame(
        rows,
        "component_type string, material_main string, mass_g double, recycled_content_pct double,"
        " supplier_region string, compliance_rohs bigint, contains_hazardous_substance bigint, grade string",
    )
