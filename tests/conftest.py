from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from cohortspan import catalog, schemas  # noqa: E402
from cohortspan.session import build_session  # noqa: E402
from cohortspan.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


# Six persons with known scores: number, birth date, sex, then visits with nine values each.
PERSONAS = [
    (9900001, "1995-03-15", "F", {"2024-05-01": "4.5 65 0.8 85 0.8 5.5 35 88 12.5"}),
    (9900002, "1978-11-22", "M", {"2024-05-01": "3.8 105 1.10 98 3.2 7.8 25 94 14.0"}),
    (
        9900003,
        "1985-08-20",
        "F",
        {
            "2023-05-01": "4.0 95 0.95 97 2.8 7.2 28 92 13.8",
            "2023-11-01": "4.2 82 0.88 90 1.8 6.5 31 90 13.2",
            "2024-05-01": "4.3 75 0.85 87 1.2 6.0 33 89 12.8",
        },
    ),
    (9900004, "1998-12-05", "M", {"2024-05-01": "4.2 85 0.90 115 4.5 8.2 28 90 13.8"}),
    (9900005, "1951-07-18", "F", {"2024-05-01": "4.1 78 1.00 89 1.5 6.2 32 91 13.0"}),
    (9900006, "1965-04-30", "M", {"2024-05-01": "3.2 135 1.80 145 8.5 9.5 22 96 15.5"}),
]


def make_tables(spark, users=(), sessions=(), measurements=(), anthropometry=(), results=(), range_set="seed") -> Tables:
    """Tables from literal rows; decimals may be given as text."""

    def frame(rows, schema):
        kinds = [f.dataType.typeName() for f in schema.fields]
        fixed = [
            tuple(Decimal(v) if k == "decimal" and v is not None else v for v, k in zip(row, kinds)) for row in rows
        ]
        return spark.createDataFrame(fixed, schema)

    return Tables(
        users=frame(users, schemas.USER),
        sessions=frame(sessions, schemas.SESSION),
        biomarkers=catalog.biomarkers(spark),
        measurements=frame(measurements, schemas.MEASUREMENT),
        anthropometry=frame(anthropometry, schemas.ANTHROPOMETRY),
        ranges=catalog.ranges(spark, range_set),
        models=catalog.models(spark),
        coefficients=catalog.coefficients(spark),
        results=frame(results, schemas.RESULT),
    )


def persona_rows(until: str = "9999-12-31"):
    users, sessions, measurements = [], [], []
    for user, (seqn, birth, sex, visits) in enumerate(PERSONAS, start=1):
        users.append((user, seqn, day(birth), sex, "group"))
        for date, values in visits.items():
            if date > until:
                continue
            number = len(sessions) + 1
            sessions.append((number, user, day(date), True))
            for biomarker, value in enumerate(values.split(), start=1):
                measurements.append((number, biomarker, value, moment(date + " 09:00:00")))
    return users, sessions, measurements


@pytest.fixture(scope="session")
def personas(spark):
    return make_tables(spark, *persona_rows())


def nine_values(session: int, when: str, **changed: str) -> list[tuple]:
    """Nine ordinary values of one visit; ``b5="0"`` changes biomarker 5, None leaves it out."""
    usual = {f"b{i}": v for i, v in enumerate("4.5 65 0.8 85 0.8 5.5 35 88 12.5".split(), start=1)}
    usual.update(changed)
    return [(session, int(k[1:]), v, moment(when)) for k, v in usual.items() if v is not None]
