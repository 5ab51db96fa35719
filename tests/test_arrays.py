"""NPZ files: rows in splits, only what is asked for, and models written and read again."""

import zipfile

import numpy as np
import pytest

from windlass.sources import arrays


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    held = {"X": rng.normal(size=(50, 3, 2)), "y": rng.integers(0, 9, 50), "names": np.array([f"n{k}" for k in range(50)]), "mean": np.zeros(6)}
    np.savez(tmp_path / "a.npz", **held)
    np.savez_compressed(tmp_path / "b.npz", **{k: v[:7] if k != "mean" else v for k, v in held.items()})
    np.savez(tmp_path / "c.npz", **{k: np.asfortranarray(v[:0]) if k != "mean" else v for k, v in held.items()})
    (tmp_path / "notes.txt").write_text("not an array")
    return tmp_path, held


def test_rows_are_read_in_splits(spark, folder):
    path, held = folder
    made = arrays.read_arrays(spark, str(path), rows=8)
    assert made.columns == ["file", "row", "X", "y", "names"]
    assert made.rdd.getNumPartitions() == 7 + 1
    rows = {(r.file.rsplit("/", 1)[1], r.row): r for r in made.collect()}
    assert len(rows) == 57 and {f for f, _ in rows} == {"a.npz", "b.npz"}
    for (_, k), r in rows.items():
        assert np.allclose(r.X, held["X"][k].ravel()) and r.y == held["y"][k] and r.names == f"n{k}"


def test_only_asked_arrays_are_touched(spark, folder):
    path, held = folder
    raw = bytearray((path / "a.npz").read_bytes())
    with zipfile.ZipFile(path / "a.npz") as z:
        at = z.getinfo("X.npy").header_offset
    raw[at + 200 : at + 600] = b"\xff" * 400  # X is damaged
    (path / "a.npz").write_bytes(raw)
    made = arrays.read_arrays(spark, str(path / "a.npz"), ["y"], rows=20)
    assert [r.y for r in made.orderBy("row").collect()] == held["y"].tolist() and made.columns == ["file", "row", "y"]
    with pytest.raises(Exception, match="no such arrays"):
        arrays.read_arrays(spark, str(path), ["nothing"]).count()


def test_models_come_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    model = {"weights": rng.normal(size=(4, 3)), "bias": rng.normal(size=3), "empty": np.zeros((0, 2))}
    rows = spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in model.items()], "name string, shape array<int>, values array<double>").repartition(2, "name")
    path = str(tmp_path / "model")
    arrays.write_arrays(rows, path)
    found = {}
    for file in (tmp_path / "model").glob("*.npz"):
        found |= dict(np.load(file))
    assert set(found) == set(model) and all(np.array_equal(found[k], v) and found[k].shape == v.shape for k, v in model.items())
    with pytest.raises(Exception, match="has files already"):
        arrays.write_arrays(rows, path)
    arrays.write_arrays(rows.where("name = 'bias'"), path, overwrite=True)
    (left,) = (tmp_path / "model").glob("*.npz")
    assert list(np.load(left)) == ["bias"]
    assert [r.bias for r in arrays.read_arrays(spark, path).orderBy("row").collect()] == model["bias"].tolist()
