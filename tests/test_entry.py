"""The driver's entry points, with and without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25 * 24 // 2  # all pairs
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators():
    code = "import sys; sys.modules['spreadloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
