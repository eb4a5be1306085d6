import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_parts(tmp_path):
    """The other queries are there when the corpus package and its pipeline are gone."""
    for name in ("spendlens", "__spark_entry__.py"):
        os.symlink(f"{REPO}/{name}", tmp_path / name)
    os.remove(tmp_path / "spendlens")
    os.mkdir(tmp_path / "spendlens")
    for name in os.listdir(f"{REPO}/spendlens"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{REPO}/spendlens/{name}", tmp_path / "spendlens" / name)
    text = open(f"{REPO}/__spark_entry__.py").read().replace("os.path.dirname(os.path.abspath(__file__))", repr(str(tmp_path)))
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(text)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    n, pipeline, oracles = out.stdout.split()
    assert int(n) > 50 and pipeline == "False" and oracles == "True", out.stderr[-500:]
