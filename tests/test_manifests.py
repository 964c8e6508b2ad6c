"""Manifests of a source tree, and issues of state spaces and processes."""

import json

from graphloom.operators import validate
from graphloom.sources import manifests as m


def test_manifests_of_a_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "a/pyproject.toml").write_text('[project]\nname = "p"\nversion = "1.2"\ndescription = "d"\ndependencies = ["requests>=2.0,<3.0", "numpy"]\n[project.optional-dependencies]\ndev = ["pytest ~= 8"]\nextra = ["rich"]\n')
    (tmp_path / "a/setup.py").write_text("from setuptools import setup\nsetup(name='s', version=\"0.1\",\n  install_requires=[\n 'flask==2.0',\n \"click\",\n ],\n extras_require={'dev': ['black>=23'], 'docs': ['sphinx'], 'test': [\"hypothesis\"]})\n")
    (tmp_path / "a/requirements.txt").write_text("# comment\n\nscipy == 1.0\n-e ./libs/own\n-e git+https://x\n")
    (tmp_path / "a/package.json").write_text(json.dumps({"name": "js", "version": "3", "dependencies": {"left-pad": "^1"}, "devDependencies": {"jest": "29"}}))
    (tmp_path / "a/Cargo.toml").write_text('[package]\nname = "rs"\nversion = "0.3"\n[dependencies]\nserde = { version = "1", features = ["derive"] }\nrand = "0.8"\nown = { path = "../own" }\n[dev-dependencies]\ncriterion = "0.5"\n')
    (tmp_path / "bad/pyproject.toml").write_text("[project\nname = ")
    (tmp_path / "bad/other.toml").write_text("x = 1")
    texts = m.manifest_texts(spark, str(tmp_path))
    got = {(r.path.rpartition("/")[0][-3:], r.manifest): (r.name, r.version, r.description) for r in m.packages(texts).collect()}
    assert got == {("0/a", "pyproject.toml"): ("p", "1.2", "d"), ("0/a", "setup.py"): ("s", "0.1", None), ("0/a", "requirements.txt"): (None, None, None), ("0/a", "package.json"): ("js", "3", None), ("0/a", "cargo.toml"): ("rs", "0.3", None), ("bad", "pyproject.toml"): (None, None, None)}
    deps = sorted(((r.manifest, r.name, r.version, r.is_dev, r.is_local) for r in m.dependencies(texts).collect()), key=repr)
    assert deps == sorted([
        ("pyproject.toml", "requests", ">=2.0,<3.0", False, False), ("pyproject.toml", "numpy", None, False, False), ("pyproject.toml", "pytest", "~= 8", True, False), ("pyproject.toml", "rich", None, False, False),
        ("setup.py", "flask", "==2.0", False, False), ("setup.py", "click", None, False, False), ("setup.py", "black", ">=23", True, False), ("setup.py", "hypothesis", None, True, False),
        ("requirements.txt", "scipy", "== 1.0", False, False), ("requirements.txt", "own", None, False, True), ("requirements.txt", "-e", "git+https://x", False, False),
        ("package.json", "left-pad", "^1", False, False), ("package.json", "jest", "29", True, False),
        ("cargo.toml", "serde", "1", False, False), ("cargo.toml", "rand", "0.8", False, False), ("cargo.toml", "own", None, False, False), ("cargo.toml", "criterion", "0.5", True, False),
    ], key=repr)


def test_issues_of_models(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = validate.state_space_issues(one([("v",), ("v",), ("w",)], "id string"), one([("a", "v"), ("a", "x"), ("a", "x")], "action string, variable string"), one([("p", "y")], "preference string, variable string"))
    assert sorted((r.issue, r.id, r.reference) for r in found.collect()) == [("action_without_variable", "a", "x"), ("duplicate_variable", "v", None), ("preference_without_variable", "p", "y")]
    ids = lambda *x: one([(i,) for i in x], "id string")
    found = validate.process_issues(ids("s", "t", "t"), one([("s", "t"), ("q", "t"), ("s", "r")], "source_stage string, target_stage string"), ids("s", "e"), ids("t", "o"))
    assert sorted((r.issue, r.id, r.reference) for r in found.collect()) == [("duplicate_stage", "t", None), ("entry_without_stage", "e", None), ("exit_without_stage", "o", None), ("link_without_source", "q>t", "q"), ("link_without_target", "s>r", "r")]
