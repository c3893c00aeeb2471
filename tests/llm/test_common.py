import os
import subprocess
import sys

import pytest

from thalweg.llm import common


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert common.shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(spark)


def test_what_was_written_goes_at_the_end(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from thalweg.llm.common import cut
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert cut(spark.range(5), "some").count() == 5
import os
assert any("thalweg" in x for x in os.listdir("{tmp_path}"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ, timeout=300)
    assert not [x for x in os.listdir(tmp_path) if "thalweg" in x]


def test_spare_names(spark):
    assert common.spare(spark.range(1), "text") == "text" and common.spare(spark.range(1).toDF("_A"), "_a") == "__a"
