import pytest
from pyspark.sql import functions as F

from filewarden.session import builder


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("filewarden-tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """`files` rows from a dict path -> str or bytes."""

    def build(contents):
        rows = [(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in contents.items()]
        return spark.createDataFrame(rows, "path STRING, content BINARY").select(
            "path",
            "content",
            F.octet_length("content").cast("bigint").alias("size"),
            F.lit(None).cast("timestamp").alias("mtime"),
        )

    return build
