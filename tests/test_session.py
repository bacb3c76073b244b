import json
import subprocess

import pytest

from tracelake import cli
from tracelake.operators import corpus, pack, session
from tracelake.sources import files as io

SHOP = {"checkout.py": "from pricing import total\n\ndef checkout(cart):\n    return total(cart)\n", "pricing.py": "RATE = 2\n\ndef total(cart):\n    return cart * RATE\n", "notes.md": "checkout notes\n"}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "shop"
    root.mkdir()
    for name, text in SHOP.items():
        (root / name).write_text(text)
    (root / "skip.bin").write_bytes(b"\0\1")
    (root / ".env").write_text("A=1")
    (root / "build").mkdir()
    (root / "build" / "x.py").write_text("x = 1\n")
    return root


def test_tree_and_git_give_the_same_files(spark, tree):
    here = {r.path: r.text for r in io.read_tree(spark, str(tree)).collect()}
    assert here == SHOP
    assert {r.path: r.reason for r in io.exclusions(spark, str(tree)).collect()} == {"skip.bin": "suffix", ".env": "secret_name", "build/x.py": "excluded_directory"}
    for c in (["init", "-q"], ["add", "-A", "-f"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tree), *c], check=True)
    (tree / "pricing.py").write_text("changed\n")
    assert {r.path: r.text for r in io.read_revision(spark, str(tree), "HEAD").collect()} == SHOP


def test_capture_check_refresh(spark, tree):
    read = lambda: io.read_tree(spark, str(tree))
    context = session.capture(read(), "checkout cart")
    assert session.context_error(context) is None and context["bundle"]["consumed"] <= 4000
    assert pack.byte_count(pack.render(context["bundle"])) == context["bundle"]["consumed"]
    assert session.check(read(), context)["recommendation"] in ("reuse", "review")
    (tree / "pricing.py").write_text(SHOP["pricing.py"].replace("RATE = 2", "RATE = 3"))
    got = session.check(read(), context)
    assert got["recommendation"] == "retrieve"
    again = session.refresh(read(), context)
    assert again["receipt"]["action"] == "retrieve" and session.context_error(again) is None
    broken = json.loads(json.dumps(context).replace("checkout(cart)", "checkout(cort)"))
    assert session.check(read(), broken)["recommendation"] == "retrieve"


def test_command_line(spark, tree, tmp_path, capsys):
    bundle, delta, graph = (str(tmp_path / f"{n}.json") for n in ("bundle", "delta", "graph"))
    assert cli.main(["bundle", str(tree), "total cart", "--output", bundle], spark) == 0
    assert cli.main(["verify", str(tree), bundle], spark) == 0
    assert cli.main(["report", str(tree), bundle], spark) == 0
    assert "Content-Security-Policy" in capsys.readouterr().out
    store = str(tmp_path / "graphs")
    assert cli.main(["graph-capture", str(tree), "checkout", store, "--output", graph], spark) == 0
    handle = json.load(open(graph))["handle"]
    assert cli.main(["graph-refresh", str(tree), store, handle], spark) == 0
    (tree / "pricing.py").write_text("def total(cart):\n    return 0\n")
    assert cli.main(["verify", str(tree), bundle], spark) == 1
    assert cli.main(["graph-refresh", str(tree), store, handle, "--output", delta], spark) == 1
    assert cli.main(["verify", str(tree), str(tmp_path / "none.json")], spark) == 2


def test_islands_and_policy(spark):
    files = spark.createDataFrame([("a.txt", "x\ny\n"), ("b.txt", "-----BEGIN PRIVATE KEY-----\n"), ("c.py", "# @generated\n"), ("d/e.egg-info/f.py", "x"), ("../g.py", "x"), ("h.min.js", "x")], "path string, text string")
    from pyspark.sql import functions as F

    got = {r.path: r.reason for r in files.select("path", corpus.exclusion(F.col("path"), F.col("text"), F.octet_length("text")).alias("reason")).collect()}
    assert got == {"a.txt": None, "b.txt": "private_key", "c.py": "generated_marker", "d/e.egg-info/f.py": "excluded_directory", "../g.py": "unsafe_path", "h.min.js": "generated_name"}
