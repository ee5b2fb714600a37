import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)

from facetry.profile import (  # noqa: E402
    IDENTIFIER_COLUMNS,
    SURVEY,
    TARGET_FLAGS_COLUMN,
    TARGET_ID,
    TEXT_IDENTIFIER,
)
from facetry.session import get_session  # noqa: E402
from facetry.sources.catalog import Catalog  # noqa: E402

TEXT_ID = IDENTIFIER_COLUMNS[TEXT_IDENTIFIER]
SF = "/root/testdata/sf0.001"
NAN = float("nan")
N_BYTES = 57


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": shared,
        "spark.sql.maxMetadataStringLength": "10000",
    }
    session = get_session("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def flag_bytes(*bits):
    values = [0] * N_BYTES
    for bit in bits:
        values[bit // 8] |= 1 << (bit % 8)
    return values


CATALOG_SCHEMA = (
    f"pipeline string, {TARGET_ID} bigint, gaia_dr3_source_id bigint, {TEXT_ID} string, tic_v8_id bigint, "
    "release string, telescope string, ra double, dec double, plx double, g_mag float, snr float, teff float, "
    "logg float, result_flags int, flag_bad int, zwarning_flags int, good boolean, same double, "
    f"{TARGET_FLAGS_COLUMN} array<smallint>"
)
NAMES = [part.split()[0] for part in CATALOG_SCHEMA.replace("array<smallint>", "a").split(", ")]


def catalog_rows():
    """30 rows over three pipelines with every kind of odd value."""
    rows = []
    for i in range(30):
        teff = [NAN, None, 3500.5, 4000.0, 9000.0, 5770.0][i % 6] if i < 12 else 3000.0 + 250 * i
        rows.append(
            {
                "pipeline": ["mwmlite", "spall", "aspcap"][i % 3],
                TARGET_ID: 100 + i // 3,
                "gaia_dr3_source_id": 4_611_686_018_427_387_904 + i,
                TEXT_ID: f"2M{i:08d}",
                "tic_v8_id": i if i % 4 else None,
                "release": [SURVEY, "old one", "other"][i % 3 if i < 15 else 0],
                "telescope": ["apo25m", "lco25m"][i % 2],
                "ra": i * 12.0,
                "dec": -90.0 + 6.2 * i,
                "plx": [0.0, -0.5, 1.25, 2.5][i % 4],
                "g_mag": 17.0 if i == 5 else 12.0 + 0.4 * i,
                "snr": 50.0 if i in (2, 9) else 10.0 * (i % 11),
                "teff": teff,
                "logg": NAN if i % 7 == 3 else 0.25 * (i % 20),
                "result_flags": i % 2,
                "flag_bad": int(i % 5 == 0),
                "zwarning_flags": [0, 4][i % 2],
                "good": None if i == 29 else i % 3 == 0,
                "same": 7.0,
                TARGET_FLAGS_COLUMN: flag_bytes() if i == 0 else flag_bytes(i, (i * 37 + 5) % 456),
            }
        )
    return rows


@pytest.fixture(scope="session")
def rows():
    return catalog_rows()


@pytest.fixture(scope="session")
def stars(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], CATALOG_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def mapping_rows():
    return [(bit, ("mwm", "bhm", "ops")[bit % 3], f"carton_{bit % 20}") for bit in range(470)]


@pytest.fixture(scope="session")
def mapping(spark, mapping_rows):
    return spark.createDataFrame(mapping_rows, "bit int, mapper string, alt_name string").cache()


@pytest.fixture(scope="session")
def catalog(stars, mapping):
    return Catalog(stars, mapping=mapping, release="dr19", datatype="star")


def close(a, b, digits=9):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and math.isnan(a):
        return math.isnan(b)
    return a == pytest.approx(b, rel=10**-digits, abs=10**-digits)
