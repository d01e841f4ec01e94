"""Array files against what was written into them: archives split by rows, binary sorter files."""

import struct
import zlib

import numpy as np
import pytest

from wavemill.sources import archives, storage


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("kind", ["<f4", ">f8", "<i2"])
def test_archives_by_rows(spark, tmp_path, compressed, kind):
    rng = np.random.default_rng(0)
    w = (rng.normal(0, 100, (1003, 7))).astype(kind)
    y, u = rng.integers(0, 2, 1003).astype(np.int8), rng.integers(0, 5, 1003).astype(np.int64)
    (np.savez_compressed if compressed else np.savez)(tmp_path / "a.npz", unit_ids=u, waveforms=w, class_labels=y, note=np.array("text"))
    np.savez(tmp_path / "b.npz", waveforms=np.asfortranarray(w[:50]))
    (tmp_path / "c.txt").write_text("not an archive")
    df = archives.read_npz(spark, str(tmp_path), rows_per_task=100)
    assert df.rdd.getNumPartitions() == (1 if compressed else 11) + 1
    rows = {(r["file"].rsplit("/", 1)[1], r["snippet_id"]): r for r in df.collect()}
    assert len(rows) == 1053
    for i in range(1003):
        r = rows["a.npz", i]
        assert (r["w"], r["class_label"], r["unit_id"]) == (w[i].astype(float).tolist(), y[i], u[i])
    for i in range(50):
        r = rows["b.npz", i]
        assert (r["w"], r["class_label"], r["unit_id"]) == (w[i].astype(float).tolist(), 1, 0)


def test_written_archives_come_back(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS snippet_id", "array(CAST(id AS DOUBLE), 1.5) AS w", "CAST(id % 2 AS INT) AS class_label", "CAST(id % 3 AS INT) AS unit_id")
    storage.write_npz(df.repartition(2), f"file://{tmp_path}/out", compressed=False)
    back = archives.read_npz(spark, f"file://{tmp_path}/out", rows_per_task=100)
    assert sorted((r["w"], r["class_label"], r["unit_id"]) for r in back.collect()) == sorted(([float(i), 1.5], i % 2, i % 3) for i in range(500))
    assert back.rdd.getNumPartitions() >= 5


def test_archives_without_snippets_are_named(spark, tmp_path):
    np.savez(tmp_path / "x.npz", other=np.zeros(3))
    with pytest.raises(Exception, match="waveforms"):
        archives.read_npz(spark, str(tmp_path)).count()


def _element(kind: int, data: bytes, order: str) -> bytes:
    if 0 < len(data) <= 4:
        return struct.pack(f"{order}I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(name: str, x: np.ndarray, order: str, cls: int = 6) -> bytes:
    code = {"f8": 9, "f4": 7, "i4": 5, "i2": 3, "u1": 2}[x.dtype.str[1:]]
    body = _element(6, struct.pack(f"{order}II", cls, 0), order) + _element(5, struct.pack(f"{order}{x.ndim}i", *x.shape), order) + _element(1, name.encode(), order)
    return body + _element(code, x.astype(x.dtype.newbyteorder(order)).tobytes("F"), order)


def mat_file(values: dict[str, np.ndarray], *, compressed: bool, order: str = "<") -> bytes:
    """A level 5 file, as the format's published description has it."""
    out = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, x in values.items():
        body = _matrix(name, x, order, 4 if name == "text" else 6)
        whole = struct.pack(f"{order}II", 14, len(body)) + body
        if compressed:
            whole = zlib.compress(whole)
            whole = struct.pack(f"{order}II", 15, len(whole)) + whole
        out += whole
    return out


def _sorter_values(n=120):
    rng = np.random.default_rng(3)
    return {
        "text": np.frombuffer(b"hello", np.uint8).reshape(1, -1),
        "newSpikeTimes": np.sort(rng.uniform(0, 60, (1, n))),
        "Waveforms": rng.normal(0, 1, (n, 64)).astype(np.float32),
        "unitIDs": (np.arange(n) % 4).astype(np.int32).reshape(-1, 1),
        "k": np.array([[7]], np.int16),
    }


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("order", ["<", ">"])
def test_matrices_of_sorter_files(spark, tmp_path, compressed, order):
    values = _sorter_values()
    (tmp_path / "s.mat").write_bytes(mat_file(values, compressed=compressed, order=order))
    archives.register(spark)
    df = spark.read.format("sorter_files").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    got: dict = {}
    for r in df.collect():
        got.setdefault(r["variable"], {})[r["row"]] = r["values"]
    assert set(got) == {"newSpikeTimes", "Waveforms", "unitIDs", "k"}
    assert [got["Waveforms"][i] for i in range(120)] == values["Waveforms"].astype(float).tolist()
    assert [got["newSpikeTimes"][i] for i in range(120)] == values["newSpikeTimes"].reshape(-1, 1).tolist()
    assert [got["unitIDs"][i][0] for i in range(120)] == values["unitIDs"].ravel().tolist() and got["k"] == {0: [7.0]}


def test_units_of_sorter_files(spark, tmp_path):
    values = _sorter_values()
    (tmp_path / "a.mat").write_bytes(mat_file(values, compressed=True))
    (tmp_path / "b.mat").write_bytes(mat_file({"times": values["newSpikeTimes"][:, :10], "snips": values["Waveforms"][:12].astype(np.float64)}, compressed=False))
    units = archives.read_sorter_files(spark, str(tmp_path))
    rows = {(r["file"].rsplit("/", 1)[1], r["spike_index"]): r for r in units.collect()}
    own = [r for (f, _), r in rows.items() if f == "a.mat"]
    assert len(own) == 120 and {r["unit_id"] for r in own} == {0, 1, 2, 3} and all(r["class_label"] == (r["unit_id"] > 0) for r in own)
    assert rows["a.mat", 5]["w"] == values["Waveforms"][5].astype(float).tolist() and rows["a.mat", 5]["t"] == values["newSpikeTimes"][0, 5]
    bare = [r for (f, _), r in rows.items() if f == "b.mat"]  # cut to the shorter array, without ids all noise
    assert len(bare) == 10 and {r["unit_id"] for r in bare} == {0}


def test_other_formats_are_named(spark, tmp_path):
    (tmp_path / "h.mat").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 200)
    with pytest.raises(ValueError, match="HDF5"):
        archives.read_sorter_files(spark, str(tmp_path))
    (tmp_path / "h.mat").write_bytes(b"\0" * 16)
    with pytest.raises(ValueError, match="level 5"):
        archives.read_sorter_files(spark, str(tmp_path))
    (tmp_path / "h.mat").write_bytes(mat_file({"k": np.array([[7]], np.int16)}, compressed=False))
    with pytest.raises(ValueError, match="spike_times"):
        archives.read_sorter_files(spark, str(tmp_path))


def test_runs_are_listed_with_their_results(spark, tmp_path):
    base = str(tmp_path / "runs")
    for i, run in enumerate(("20240101_000000", "20250101_000000", "20240601_120000")):
        storage.write_json(spark, f"{base}/{run}/other.json", {"a": i})
        if i:
            storage.write_json(spark, f"{base}/{run}/run_summary.json", {"n": i, "best": f"b{i}"})
    storage.write_json(spark, f"{base}/.hidden/run_summary.json", {"n": 9, "best": "h"})
    rows = storage.runs(spark, base, "n long, best string").collect()
    assert [(r["run"], r["place"], r["n"], r["best"], r["n_files"]) for r in rows] == [("20250101_000000", 1, 1, "b1", 2), ("20240601_120000", 2, 2, "b2", 2), ("20240101_000000", 3, None, None, 1)]
    assert all(r["bytes"] > 0 and r["changed"] is not None for r in rows) and storage.list_runs(spark, base) == [r["run"] for r in rows]


def test_results_of_a_run_in_one_archive(spark, tmp_path):
    import io
    import zipfile

    run = str(tmp_path / "run")
    storage.write_json(spark, f"{run}/summary.json", {"a": 1, "b": {"c": [1, 2]}})
    storage._write_text(spark, f"{run}/sub/ranks.json", '[{"f": "x,y", "r": 1}, {"f": "z"}]')
    storage._write_text(spark, f"{run}/one.json", "[3, 4]")
    storage._write_text(spark, f"{run}/broken.json", "{")
    assert sorted(storage.export_zip(spark, run, str(tmp_path / "out.zip"))) == ["one.csv", "sub__ranks.csv", "summary.csv"]
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out.zip").read_bytes())) as z:
        assert z.read("sub__ranks.csv").decode().splitlines() == ["f,r", '"x,y",1', "z,"]
        assert z.read("summary.csv").decode().splitlines() == ["key,value", "a,1", 'b,"{""c"": [1, 2]}"'] and z.read("one.csv").decode().splitlines() == ["value", '"[3, 4]"']


def test_profiles_are_records(spark, tmp_path):
    from pyspark.sql import functions as F

    from wavemill.operators import profiling

    df = spark.createDataFrame([(i, [float(i)] * 8) for i in range(40)], "snippet_id long, w array<double>")
    rows = profiling.profile(df, repeats=1, notes="test", path=str(tmp_path / "p"))
    back = {r["kernel"]: r for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert len(rows) == len(back) == 6
    for r in back.values():
        assert (r["n_snippets"], r["n_samples"], r["notes"]) == (40, 320, "test") and r["arith_total"] == 320 * r["arith_per_sample"]
        assert r["samples_per_s"] == pytest.approx(320 / r["seconds"]) and r["spark_version"] == spark.version and r["run_at"]
    own = profiling.profile_kernel(df, "mine", lambda w: F.transform(w, lambda x: x + 1), repeats=2, backend="own")
    assert (own["kernel"], own["backend"], own["n_samples"], own["arith_total"]) == ("mine", "own", 320, None)
    assert profiling.profile_kernel(df.limit(0), "mine", lambda w: w)["n_samples"] == 0
    assert profiling.profile_block("teager_energy", np.ones((10, 64)))["n_samples"] == 640
