import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pageloom.session import local_session

    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate SQL text with named string (or null) inputs."""

    def run(sql: str, **inputs):
        columns = [f"cast({'null' if v is None else repr_sql(v)} as string) as {k}" for k, v in inputs.items()]
        return spark.range(1).selectExpr(*columns or ["1 as one"]).selectExpr(f"{sql} as v").first()[0]

    return run


def repr_sql(text: str) -> str:
    from pageloom.functions import text as literal

    return literal(text)


@pytest.fixture(scope="session")
def pages(spark):
    def make(*html: str, url: str = "https://www.site.example/dir/page"):
        rows = [(i, url, h) for i, h in enumerate(html)]
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return make
