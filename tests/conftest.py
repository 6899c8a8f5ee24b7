import os
import sys

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Hooks that tests define are imported by the Python workers.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    texts = [
        "Cats purr when they are happy. Cats sleep most of the day.",
        "Dogs bark at strangers. Dogs fetch sticks in the park.",
        "The moon orbits the earth. The earth orbits the sun.",
        "Bread needs flour, water and yeast. Bread rises in the oven.",
    ]
    return spark.createDataFrame(
        [(i, t, f"file{i}.txt") for i, t in enumerate(texts)], "doc_id bigint, text string, filename string"
    )


@pytest.fixture(scope="session")
def questions(spark):
    rows = [
        (0, "Why do cats purr?", "Cats purr when they are happy."),
        (1, "What orbits the earth?", "The moon orbits the earth."),
        (2, "Zebras quagga okapi?", "Nothing is known."),
    ]
    return spark.createDataFrame(rows, "qid bigint, question string, ground_truth string")
