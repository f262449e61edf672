"""What was submitted stands; defaults fill in what was not."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from transitlake.session import checkpoint_dir, get_spark
s = get_spark("t", master="local[3]")
print("GOT", s.sparkContext.master, s.conf.get("spark.sql.session.timeZone"), s.conf.get("spark.sql.files.maxPartitionBytes"), checkpoint_dir(s))
"""


def run(**env):
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], env=os.environ | env, capture_output=True, text=True, timeout=300)
    return next(line for line in out.stdout.splitlines() if line.startswith("GOT")).split()[1:]


def test_submitted_settings_survive(tmp_path):
    args = f"--master local[2] --conf spark.sql.session.timeZone=Asia/Tokyo --conf spark.checkpoint.dir=file://{tmp_path} pyspark-shell"
    master, zone, split, folder = run(PYSPARK_SUBMIT_ARGS=args)
    assert (master, zone, split) == ("local[2]", "Asia/Tokyo", "128m") and str(tmp_path) in folder


def test_defaults_without_a_submission():
    assert run()[:3] == ["local[3]", "UTC", "128m"]


def test_only_what_a_block_made_is_dropped(spark):
    from transitlake.session import collected, drop, stored
    kept = stored(spark.range(3), "kept")
    with collected() as made:
        gone = stored(spark.range(4), "gone")
        with collected() as inner:
            nested = stored(spark.range(5), "nested")
    after = stored(spark.range(6), "after")
    assert len(made) == len(inner) == 1 and gone.count() == 4
    drop(spark, made)
    assert [x.count() for x in (kept, nested, after)] == [3, 5, 6] and not os.path.exists(made[0].removeprefix("file:"))
