"""The entry module, with and without the optional operators."""

import subprocess
import sys

import __spark_entry__ as entry

WITHOUT = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("pointsim.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = e.queries()
assert "igi_knn_top5" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert e.oracle_sql().keys() <= names.keys()
"""


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "cloud_id", "votes"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_without_the_optional_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], check=True)
