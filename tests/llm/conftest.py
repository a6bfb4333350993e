from __future__ import annotations

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    """Rows of a small table as tuples, read without Spark."""

    def rows(name: str, columns: str) -> list[tuple]:
        return duckdb.sql(f"SELECT {columns} FROM '{os.path.join(SF, name)}.parquet'").fetchall()

    return rows
