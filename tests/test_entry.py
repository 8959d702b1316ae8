"""The entry points, with the corpus side and without it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(*q); print(all(isinstance(x, str) for x in o.values()), set(o) <= set(q))"


def asked(root):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=root, env=env, capture_output=True, text=True, check=True).stdout
    names, flags = out.strip().split("\n")[-2:]
    return set(names.split()), flags


def test_every_oracle_is_text_of_a_query():
    names, flags = asked(ROOT)
    assert flags == "True True" and "monthly_from_ytd" in names


def test_report_queries_stand_without_the_corpus_side(tmp_path):
    for part in ("reportloom", "__spark_entry__.py"):
        there = os.path.join(ROOT, part)
        if os.path.isdir(there):
            shutil.copytree(there, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(there, tmp_path / part)
    names, flags = asked(tmp_path)
    assert flags == "True True" and "monthly_from_ytd" in names and not any(n.startswith("op") for n in names)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path / "corpus_pipeline.py")  # a leftover that can't be used is not asked
    assert asked(tmp_path)[0] == names


def test_the_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
