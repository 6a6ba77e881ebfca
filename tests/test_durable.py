import subprocess
import sys
from pathlib import Path

from cairn.durable import Workspace, shared_root


def test_cut_keeps_rows_and_drops_lineage(spark):
    space = Workspace(spark, "test")
    df = spark.range(10).selectExpr("id", "cast(null as string) as s")
    out = space.cut(df, "ids")
    assert out.dtypes == df.dtypes and out.count() == 10
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert space.path.startswith(shared_root(spark).rstrip("/"))
    assert space.cut(df.limit(0), "none").count() == 0
    path = space.save(df, "more")
    space.drop(path)
    assert not Path(path.removeprefix("file:")).exists()


def test_workspaces_are_removed_when_the_driver_ends(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "from cairn.durable import Workspace\n"
        "w = Workspace(s, 'x'); w.save(s.range(3), 'a'); print('PATH', w.path)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
    path = next(line for line in done.stdout.splitlines() if line.startswith("PATH")).split()[1]
    assert path.startswith(f"file://{tmp_path}") and not Path(path.removeprefix("file://")).exists()
