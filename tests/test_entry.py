import __spark_entry__ as E

from factlens.plans import fixtures as fx


def test_entry_flagship(spark):
    rows = E.entry(spark).collect()
    assert {r.data for r in rows} >= {fx.DATASET}
    assert all(0.0 <= r.p_at_1 <= r.p_at_20 <= 1.0 for r in rows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_build_and_run_on_smallest_data(spark):
    qs = E.queries()
    for name in ("template_case", "prompt_length", "scene_entities", "kv_log_parse", "balanced_sample"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0


def test_modules_import_without_a_session():
    """The driver may import the entry module before it creates a session."""
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); import importlib, pkgutil, factlens\n"
            "[importlib.import_module(m.name) for m in pkgutil.walk_packages(factlens.__path__, 'factlens.')]\n"
            "import re, __spark_entry__ as E; own = lambda d: [k for k in d if not re.match('op[0-9]+_|pipeline$', k)]; assert len(own(E.queries())) == 54 and len(own(E.oracle_sql())) == 54")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    r = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]
