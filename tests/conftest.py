import os
import sys

import hypothesis
import pytest

hypothesis.settings.register_profile("cartulary", deadline=None)  # a first call may be slow
hypothesis.settings.load_profile("cartulary")

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """Two files, three functions, one class, one type."""
    from cartulary import schema

    rows = {
        "files": [("src/auth.ts", "src/auth.ts", "typescript", "h1", 200, False, None), ("src/user.ts", "src/user.ts", "typescript", "h2", 150, False, None)],
        "functions": [
            ("src/auth.ts:authenticate", "authenticate", "authenticate", "src/auth.ts", "(user: string) => boolean", "Checks a user.\nMore.", 5, 1, 20, True, True),
            ("src/auth.ts:refreshToken", "refreshToken", "refreshToken", "src/auth.ts", "() => void", "", 2, 22, 30, True, False),
            ("src/user.ts:getUser", "getUser", "getUser", "src/user.ts", "(id: string) => User", "Loads.", 1, 1, 5, False, False),
        ],
        "classes": [("src/auth.ts:Session", "Session", "src/auth.ts", ["src/auth.ts:refreshToken", "src/auth.ts:gone"], [], "src/auth.ts:Base", [], True)],
        "types": [("src/user.ts:User", "User", "interface", "src/user.ts", ["id", "name"])],
        "relationships": [("r1", "src/auth.ts", "src/user.ts", "imports", {"specifier": "./user"}), ("r2", "src/auth.ts", "nowhere", "imports", {})],
        "embeddings": [("src/auth.ts:authenticate", "function", [1.0, 0.0]), ("src/user.ts:getUser", "function", [0.6, 0.8]), ("src/auth.ts:Session", "class", [1.0, 0.0])],
    }
    return {k: spark.createDataFrame(v, schema.TABLES[k]) for k, v in rows.items()}
