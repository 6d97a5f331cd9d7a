import subprocess
import sys


def test_library_does_not_import_llm():
    code = "import sys, __spark_entry__ as e\nsys.modules['lamina.llm'] = None\nsys.modules['corpus_pipeline'] = None\nq, s = e.queries(), e.oracle_sql()\nassert len(q) > 100 and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)\nassert not any(m.startswith('lamina.llm.') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["a", "b", "cells", "worst"] and df.count() > 0
