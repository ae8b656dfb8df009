"""Workers see the package and run on their task's cores."""

import pandas as pd

from graphloom.session import ship


def test_workers_get_one_thread(spark):
    ship(spark)

    def seen(batches):
        import os

        for _ in batches:
            yield pd.DataFrame({"n": [os.environ.get("OMP_NUM_THREADS"), os.environ.get("OPENBLAS_NUM_THREADS")]})

    assert [r.n for r in spark.range(1).mapInPandas(seen, "n string").collect()] == ["1", "1"]
