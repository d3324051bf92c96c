"""The scratch folder and the shipped package."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

from driftline.session import scratch, scratch_path, scratch_root, written


def test_what_a_block_wrote_is_deleted_at_its_end(spark):
    rows = spark.range(3)
    outside = written(rows, "outside")
    with scratch(spark):
        inside = scratch_path(spark, "x")
        assert written(rows, "inside").count() == 3
        with scratch(spark):
            assert os.path.dirname(scratch_path(spark, "y")) != os.path.dirname(inside)
    folder = os.path.dirname(inside).removeprefix("file:").replace("//", "/")
    assert folder.startswith(scratch_root(spark).removeprefix("file:").replace("//", "/")) and not os.path.exists(folder)
    assert outside.count() == 3


def test_a_shipped_package_runs_from_any_folder(tmp_path):
    """Executors that find the package nowhere get it from the driver."""
    repo = Path(__file__).resolve().parents[1]
    code = f"""
        import sys
        sys.path.insert(0, {str(repo)!r})
        from driftline.functions.text import changed_json
        from driftline.session import build_session, ship
        from pyspark.sql import functions as F
        spark = build_session("ship", cores="1", partitions=1, memory="1g")
        ship(spark)

        def where(batches):
            import driftline.functions.text as t
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_pydict({{"at": [t.__file__] * b.num_rows}})

        print("AT", spark.range(1).mapInArrow(where, "at string").first().at)
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ".zip" in out.stdout.split("AT ")[1], out.stderr[-2000:]
