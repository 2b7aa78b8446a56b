"""Folders brought to the state of others, and audits that read little."""

import numpy as np
import pytest

from granulon.sources import readers, sync


def files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.startswith(".")}


@pytest.fixture
def folders(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    for n, x in (("same.txt", b"1"), ("other.txt", b"new"), ("new é+%20 x.txt", b"2"), ("empty.txt", b""), ("large.bin", bytes(range(256)) * 40_000)):
        (a / n).write_bytes(x)
    for n, x in (("same.txt", b"1"), ("other.txt", b"old"), ("stray.txt", b"3"), (".part-7", b"half")):
        (b / n).write_bytes(x)
    return a, b


def test_plan_and_dry_run(spark, folders):
    a, b = folders
    before = files(b)
    steps = {r.name: r.action for r in sync.plan(sync.contents(spark, str(a)), sync.contents(spark, str(b))).collect()}
    assert steps == {"same.txt": "keep", "other.txt": "replace", "new é+%20 x.txt": "copy", "empty.txt": "copy", "large.bin": "copy", "stray.txt": "delete"}
    assert files(b) == before


def test_synchronised(spark, folders):
    a, b = folders
    assert sync.synchronise(spark, str(a), str(b)) == {"copy": 3, "replace": 1, "delete": 1}
    assert files(b) == files(a)
    assert sync.synchronise(spark, str(a), str(b)) == {}


def test_strays_may_stay_and_targets_be_new(spark, folders):
    a, b = folders
    sync.synchronise(spark, str(a), str(b), strays=False)
    assert files(b) == files(a) | {"stray.txt": b"3"}
    assert sync.synchronise(spark, str(a), str(a.parent / "c" / "d"), "*.txt") == {"copy": 4}


def test_a_run_that_was_stopped_is_completed(spark, folders):
    a, b = folders
    steps = sync.plan(sync.contents(spark, str(a)), sync.contents(spark, str(b)))
    some = steps.where("name in ('other.txt', 'stray.txt')")
    sync.apply(some, str(a), str(b)).collect()
    all_steps = spark.createDataFrame([("other.txt", "replace"), ("stray.txt", "delete"), ("large.bin", "copy")], "name string, action string")
    done = {r.name: r.done for r in sync.apply(all_steps, str(a), str(b)).collect()}  # the old plan again
    assert done == {"other.txt": True, "stray.txt": False, "large.bin": True}
    sync.synchronise(spark, str(a), str(b))
    assert files(b) == files(a)


@pytest.mark.parametrize("name", ["../x", "", "..", "a/b"])
def test_no_step_leaves_the_folder(spark, folders, name):
    with pytest.raises(Exception, match="leads elsewhere"):
        sync.apply(spark.createDataFrame([(name, "delete")], "name string, action string"), str(folders[0]), str(folders[1])).collect()


def test_headers_are_read_without_values(spark, tmp_path):
    for k in range(3):
        np.save(tmp_path / f"{k}.npy", np.ones((3, 200, 300), np.float32))
    got = readers.flow_headers(spark, str(tmp_path)).collect()
    assert all(r.ok and r.shape == [3, 200, 300] and r.dtype == "float32" for r in got)
    assert sum(r.bytes_read for r in got) * 1000 < sum(r.length for r in got)


def test_audit_of_odd_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "VALUES", 64)
    good = np.arange(60, dtype=np.float32).reshape(3, 4, 5)
    bad = good.copy()
    bad[2, 3, 4] = np.inf
    for name, array in (("good", good), ("bad", bad), ("double", good.astype(float)), ("ints", good.astype(int)), ("two", good[:2]), ("flat", good[0]), ("none", np.zeros((3, 0, 4), np.float32))):
        np.save(tmp_path / f"{name}.npy", array)
    (tmp_path / "short.npy").write_bytes((tmp_path / "good.npy").read_bytes()[:-4])
    (tmp_path / "no.npy").write_bytes(b"no array")
    heads = {r.image_id: r.ok for r in readers.flow_audit(spark, str(tmp_path)).collect()}
    assert heads == {"good": True, "bad": True, "double": True, "ints": False, "two": False, "flat": False, "none": True, "short": False, "no": False}
    values = {r.image_id: (r.ok, r.finite) for r in readers.flow_audit(spark, str(tmp_path), header_only=False).collect()}
    assert values == {k: (v and k != "bad", None if not v or k == "none" else k != "bad") for k, v in heads.items()}
