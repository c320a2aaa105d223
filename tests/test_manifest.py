import os

from callsight.operators import manifest
from callsight.sinks import tables as sinks


def statuses(spark, folder, listed):
    digests = manifest.file_digests(manifest.read_artifacts(spark, folder))
    return {r["file"]: r["status"] for r in manifest.verify_manifest(listed, digests).collect()}


def test_files_called_alike_stay_apart(spark, tmp_path):
    folder = tmp_path / "files"
    for name in ("a/x.txt", "b/x.txt", "b/files/x.txt", "x y.txt"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(name)
    sinks.write_manifest(spark, str(folder), str(tmp_path / "manifest"))
    listed = sinks.read_manifest(spark, str(tmp_path / "manifest"))
    names = {"a/x.txt", "b/x.txt", "b/files/x.txt", "x y.txt"}
    assert statuses(spark, str(folder), listed) == dict.fromkeys(names, "ok")
    assert statuses(spark, f"file://{folder}/", listed) == dict.fromkeys(names, "ok")
    (folder / "b/x.txt").write_text("edited")
    (folder / "a/x.txt").unlink()
    assert statuses(spark, str(folder), listed) == dict.fromkeys(names, "ok") | {"b/x.txt": "mismatch", "a/x.txt": "missing"}


def test_a_relative_folder_whose_name_is_found_again_above_it(spark, tmp_path, monkeypatch):
    folder = tmp_path / "out" / "a" / "out"
    (folder / "b" / "out").mkdir(parents=True)
    (folder / "b" / "x.txt").write_text("x")
    (folder / "b" / "out" / "y.txt").write_text("y")
    names = lambda path: {row.file for row in manifest.read_artifacts(spark, path).collect()}
    assert names(str(folder)) == names(f"file://{folder}") == {"b/x.txt", "b/out/y.txt"}
    there = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")  # what relative paths are relative to
    assert names(os.path.relpath(folder, there)) == {"b/x.txt", "b/out/y.txt"}
