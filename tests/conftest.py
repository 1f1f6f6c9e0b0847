import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import session  # noqa: E402
from siftwell import Roles  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("8")


def day(n):
    return dt.datetime(2023, 1, n)


@pytest.fixture(scope="session")
def jobs3(spark):
    rows = [("1", "job1", "success", day(1), 10.0), ("2", "job2", "failed", day(2), 20.0), ("3", "job3", "running", day(3), 30.0)]
    return spark.createDataFrame(
        rows, "job_id string, job_name string, status string, created_at timestamp_ntz, duration_minutes double"
    )


@pytest.fixture(scope="session")
def jobs5(spark):
    rows = [
        ("1", "database_backup", "success", "Daily backup of database", day(1), 10.0),
        ("2", "data_processing", "failed", "Process customer data", day(2), 20.0),
        ("3", "security_scan", "running", "Scan for vulnerabilities", day(3), 30.0),
        ("4", "database_cleanup", "success", "Clean old records", day(4), 15.0),
        ("5", "etl_pipeline", "failed", "Data pipeline failure", day(5), 25.0),
    ]
    return spark.createDataFrame(
        rows,
        "job_id string, job_name string, status string, description string, created_at timestamp_ntz, duration_minutes double",
    )


@pytest.fixture(scope="session")
def products(spark):
    rows = [
        ("P001", "Organic Apples", "Fruit", 4.5, 120, "in_stock", "Fresh organic apples", "2023-01-05"),
        ("P002", "Olive Oil", "Pantry", 12.0, 40, "in_stock", "Cold pressed organic oil", "2023-01-06"),
        ("P003", "Rye Bread", "Bakery", 3.2, 25, "in_stock", "Baked every morning", "2023-01-07"),
        ("P004", "Organic Carrots", "Vegetables", 2.1, 90, "in_stock", "Organic carrots by the bunch", "2023-01-08"),
        ("P005", "Butter Croissant", "Bakery", 1.8, 0, "out_of_stock", "Layered pastry", "2023-01-09"),
        ("P006", "Whole Milk", "Dairy", 1.5, 60, "in_stock", "One litre", "2023-01-10"),
        ("P007", "Organic Eggs", "Dairy", 5.4, 75, "in_stock", "Free range organic eggs", "2023-01-11"),
        ("P008", "Smoked Salmon", "Fish", 15.9, 12, "in_stock", "Sliced, 200 g", "2023-01-12"),
        ("P009", "Seeded Rolls", "Bakery", 2.6, 0, "out_of_stock", "Six rolls", "2023-01-13"),
        ("P010", "Green Tea", "Drinks", 6.0, 33, "in_stock", "Loose leaf", "2023-01-14"),
    ]
    return spark.createDataFrame(
        rows,
        "product_id string, product_name string, category string, price double, stock long, status string, description string, created_at string",
    )


JOBS = Roles(id="job_id", name="job_name", status="status", timestamps=("created_at",), texts=("description",))
PRODUCTS = Roles(id="product_id", name="product_name", status="status", timestamps=("created_at",))


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())
