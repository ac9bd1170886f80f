"""Sources that read files: specs, trees, logs of several folders; and snapshots with their manifests."""

import json
import os

from cataloom.operators import paths, restore
from cataloom.sources import catalog, runlogs, specs


def test_specs(spark, tmp_path):
    pairs = [{"source-path": "code/a", "output-path": "docs/a", "team": "T", "update_existing": True}, {"source-path": "code/b", "output-path": "docs/b", "mode": "single"}]
    (tmp_path / "sources_x.json").write_text(json.dumps({"root-directory": "/r", "path-pairs": pairs}))
    (tmp_path / "other.json").write_text("{}")
    rows = specs.read_specs(spark, str(tmp_path)).collect()
    assert [(r.root_directory, r.position, r.source_path, r.output_path, r.team, r.mode, r.update_existing) for r in rows] == [("/r", 0, "code/a", "docs/a", "T", None, True), ("/r", 1, "code/b", "docs/b", None, "single", None)]


def test_trees_and_logs(spark, tmp_path):
    for i, name in enumerate(("a/x.SQL", "a/b/y.sql", "c/run.log", "d/old.txt", "d/none.txt")):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"{runlogs.HEADER_BEGIN}\n" if "run" in name or "old" in name else "x" * (i + 1))
        os.utime(file, (1_000_000 - i * 1000,) * 2)
    assert sorted(r.path.rpartition("/")[2] for r in paths.scan(spark, str(tmp_path), [".sql"]).collect()) == ["x.SQL", "y.sql"]
    logs = runlogs.read_logs(spark, [str(tmp_path / "d"), str(tmp_path / "c"), str(tmp_path)]).collect()
    assert [r.path.rpartition("/")[2] for r in logs] == ["run.log", "old.txt"]


def test_manifests_tell_what_changed(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    was = catalog.manifest(spark, str(tmp_path)).collect()
    (tmp_path / "a").write_text("changed")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    state = restore.check_manifest(catalog.manifest(spark, str(tmp_path)), spark.createDataFrame(was))
    assert {r.path[-1]: r.state for r in state.collect()} == {"a": "changed", "b": "missing", "c": "same", "d": "new"}
