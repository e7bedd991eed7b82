import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sourceloom.session import Workspace, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.adaptive.enabled": "true"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ws(spark):
    return Workspace(spark, "tests")


@pytest.fixture
def many_pieces(spark):
    """Range cuts of small tables stay in several pieces, as they do for large ones."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


# Two small repositories: Python with a cycle and a hub, Java with a framework.
FILES = [
    ("warehouse", "stock/levels.py", "python", "source",
     "from stock.units import Pallet\nimport stock.limits\n\ndef level(pallet):\n    if pallet:\n        return stock.limits.TOP\n    return 0\n"),
    ("warehouse", "stock/units.py", "python", "source", "from stock.levels import level\n\nclass Pallet:\n    weight = 12\n"),
    ("warehouse", "stock/limits.py", "python", "source", "TOP = 40  # pallets in one aisle\n"),
    ("warehouse", "gate/main.py", "python", "source",
     "import stock.limits\nimport stock.levels\n\nif __name__ == '__main__':\n    for aisle in range(stock.limits.TOP):\n        print(aisle)\n"),
    ("warehouse", "checks/levels_test.py", "python", "test", "import stock.levels\nimport unittest\n"),
    ("kiosk", "menu/Board.java", "java", "source", "import org.springframework.web.bind.annotation.GetMapping;\n\npublic class Board {\n    int rows = 7;\n}\n"),
    ("kiosk", "menu/Price.java", "java", "source", "public class Price {\n    int cents = 250;\n}\n"),
]


@pytest.fixture(scope="session")
def two_repos(spark):
    rows = [(r, p, c, language, kind, len(c)) for r, p, language, kind, c in FILES]
    return spark.createDataFrame(
        rows, "repo string, path string, content string, language string, file_type string, size_bytes bigint"
    ).cache()


def one_file(spark, content, language, path="a"):
    return spark.createDataFrame(
        [("r", path, content, language, "source", len(content))],
        "repo string, path string, content string, language string, file_type string, size_bytes bigint",
    )
