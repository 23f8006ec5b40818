"""Sources, configuration, metrics, whole runs and streams."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.config import Config, StainConfig
from lumenframe.functions import calibration
from lumenframe.operators import metrics
from lumenframe.plans import batch
from lumenframe.sources import discovery, pixels, readers, samples, tiff
from lumenframe.streaming import ingest


@pytest.mark.parametrize("image", [np.arange(12, dtype=np.uint16).reshape(3, 4), np.arange(24, dtype=np.uint8).reshape(2, 3, 4), np.linspace(0, 1, 6, dtype=np.float32).reshape(2, 3)])
def test_tiff_round_trip(image):
    back, px, pz = tiff.decode(tiff.encode(image, 0.25, 2.0))
    assert back.dtype == image.dtype and np.array_equal(back, image)
    assert math.isclose(px, 0.25, rel_tol=1e-5) and pz == 2.0


def test_tiff_files_and_samples(spark, tmp_path):
    for folder, names in {"one": ["dapi.tif", "dapi.tiff", "gfp.TIF", "notes.txt"], "two/Analysis": ["dapi.tif"], "three": ["gfp.tif"]}.items():
        (tmp_path / folder).mkdir(parents=True)
        for n in names:
            (tmp_path / folder / n).write_bytes(tiff.encode(np.ones((2, 2), np.uint8)))
    (tmp_path / "three/bad.tif").write_bytes(b"not an image")
    files = discovery.listing(spark, str(tmp_path))
    found = {(r["stem"], r["ext"]) for r in discovery.channels(files).where("dir like '%one'").collect()}
    assert found == {("dapi", "tif"), ("gfp", "tif")}
    config = Config(channel_roles={"dapi": "nuclear", "gfp": "stain"})
    assert [r["sample_id"] for r in discovery.samples(files, config).collect()] == ["one"]
    assert discovery.samples(files, Config(input_mode="file_per_sample")).count() == 4
    read = tiff.read_tiff(spark, str(tmp_path))
    assert read.where("error is not null").count() == 1 and read.where("error is null and size(blocks) = 1").count() == 5
    assert tiff.pixel_rows(read).count() == 20


def packed(rows: bytes, compression: int) -> bytes:
    if compression == tiff.PACKBITS:
        return b"".join(bytes([len(rows[i : i + 100]) - 1]) + rows[i : i + 100] for i in range(0, len(rows), 100)) + bytes([256 - 3, 9])
    return zlib.compress(rows) if compression == tiff.DEFLATE else rows


def tiff_of(planes, compression=1, predictor=1, rows=2, description=b"", samples=1, tile=None):
    """A file of planes (y, x, sample) in strips of ``rows`` or square tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for p in planes:
        h, w = p.shape[:2]
        parts = []
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, samples), p.dtype)
            full[:h, :w] = p
            parts = [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            parts = [p[y : y + rows] for y in range(0, h, rows)]
        places = []
        for part in parts:
            a = part.copy()
            if predictor == 2:
                a[:, 1:] = part[:, 1:] - part[:, :-1]
            data = packed(a.tobytes(), compression)
            places.append((len(out), len(data)))
            out += data
        arrays = []
        for k in (0, 1):
            arrays.append(len(out))
            out += b"".join(struct.pack("<I", x[k]) for x in places)
        text_at = len(out)
        out += description + b"\0"
        n = len(places)
        value = lambda k: arrays[k] if n > 1 else places[0][k]  # noqa: B023, E731
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, p.dtype.itemsize * 8), (259, 3, 1, compression), (270, 2, len(description) + 1, text_at)]
        tags += [] if tile else [(273, 4, n, value(0))]
        tags += [(277, 3, 1, samples)] + ([] if tile else [(278, 4, 1, rows), (279, 4, n, value(1))]) + [(317, 3, 1, predictor)]
        tags += [(322, 4, 1, tile), (323, 4, 1, tile), (324, 4, n, value(0)), (325, 4, n, value(1))] if tile else []
        tags += [(339, 3, 1, {"u": 1, "i": 2, "f": 3}[p.dtype.kind])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("samples", [1, 3])
def test_tiff_strips_tiles_and_compressions(compression, predictor, tile, samples):
    image = np.random.default_rng(1).integers(0, 60000, (21, 35, samples), dtype=np.uint16)
    got, _, _ = tiff.decode(tiff_of([image], compression, predictor, 4, b"", samples, tile))
    want = image[:, :, 0] if samples == 1 else np.moveaxis(image, 2, 0)
    assert np.array_equal(got, want)


def test_lzw():
    def pack(data):
        words, width, bits, out = {bytes([i]): i for i in range(256)}, 9, "", []
        n, bits, held = 258, f"{256:09b}", b""
        for b in data:
            more = held + bytes([b])
            if more in words:
                held = more
                continue
            bits += f"{words[held]:0{width}b}"
            words[more] = n
            n += 1
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
            if n == 4094:
                bits += f"{256:012b}"
                words, width, n = {bytes([i]): i for i in range(256)}, 9, 258
            held = bytes([b])
        bits += f"{words[held]:0{width}b}" + f"{257:0{9 if n + 1 < 512 else 10 if n + 1 < 1024 else 11 if n + 1 < 2048 else 12}b}"
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))

    rng = np.random.default_rng(3)
    for data in (b"a", b"aaaaaaaa", bytes(rng.integers(0, 4, 20_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 9000, dtype=np.uint8))):
        assert tiff.unpacked_lzw(pack(data)) == data


def test_bundled_channels_and_samples(spark, tmp_path):
    """Axes beside Z, Y and X become channels; a stack without metadata is a stack; blocks are many, headers read no pixels."""
    planes = [np.full((5, 4, 1), 10 * z + c, np.uint8) for z in range(3) for c in range(2)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "img.tif").write_bytes(tiff_of(planes, tiff.DEFLATE, description=b"ImageJ=1.0\nimages=6\nchannels=2\nslices=3\nunit=um\nspacing=1.5\n"))
    (tmp_path / "s" / "plain.tif").write_bytes(tiff_of(planes[:3]))
    (tmp_path / "s" / "img.npy2").write_bytes(b"other")
    heads = {r["path"].rsplit("/", 1)[1]: r for r in tiff.read_tiff(spark, str(tmp_path)).collect()}
    img = heads["img.tif"]
    assert (img["axes"], img["channels"], img["is_3d"], img["pz"], len(img["blocks"])) == ("ZCYX", ["_c0", "_c1"], True, 1.5, 18)
    assert (heads["plain.tif"]["axes"], heads["plain.tif"]["channels"]) == ("ZYX", [""])
    found = samples.load(spark, str(tmp_path), Config(pixel_size_um=None, channel_roles={"img_c1": "nuclear"}))
    got = {(r["channel"], r["z"]): (r["n"], r["v"]) for r in found.pixels.groupBy("channel", "z").agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()}
    assert got == {(f"img_c{c}", z): (20, 10.0 * z + c) for z in range(3) for c in range(2)} | {("plain", z): (20, [0.0, 1.0, 10.0][z]) for z in range(3)}
    assert [(r["pz"], r["is_3d"]) for r in found.calibration.collect()] == [(1.5, True)]
    by_file = samples.load(spark, str(tmp_path), Config(input_mode="file_per_sample"))
    assert {(r["sample_id"].rsplit("/", 1)[1], r["channel"]) for r in by_file.pixels.select("sample_id", "channel").distinct().collect()} == {("img", "c0"), ("img", "c1"), ("plain", "c0")}


def test_labels_beside_the_sample_or_in_its_results(spark, tmp_path):
    for folder in ("a", "b/Analysis"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "nuc.tif").write_bytes(tiff.encode(np.array([[0, 3], [3, 9]], np.uint16)))
    got = sorted((r["sample_id"].rsplit("/", 1)[1], r["y"], r["x"], r["label"]) for r in samples.labels(spark, str(tmp_path), "nuc").collect())
    assert got == [(s, *p) for s in "ab" for p in ((0, 1, 3), (1, 0, 3), (1, 1, 9))]


def test_reader_of_another_format(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "dapi.raw8").write_bytes(bytes([1, 2, 3]))
    before = dict(readers._readers)

    def heads(files):
        none = "cast(null as double) px, cast(null as double) pz, cast(null as string) unit"
        own = files.selectExpr("path", "'YX' axes", "array(1, 3) shape", "'u1' dtype", "1 compression", "1 predictor", none.split(",")[0], *[x.strip() for x in none.split(",")[1:]], "false is_3d", "array('') channels")
        return own.selectExpr("*", f"cast(array() as array<{tiff.BLOCK}>) blocks", "cast(null as string) error")

    def rows(found):
        data = found.sparkSession.read.format("binaryFile").load(f"file://{tmp_path}/s").select("path", F.posexplode(F.split(F.hex("content"), "(?<=\\G..)")).alias("x", "h")).where("h != ''")
        return data.join(found.select("path"), "path").selectExpr("path", "'' suffix", "0 z", "0 y", "x", "cast(conv(h, 16, 10) as double) v")

    try:
        readers.register(".RAW8", readers.Reader(heads, rows))
        found = samples.load(spark, str(tmp_path), Config(channel_roles={"dapi": "nuclear"}))
        assert sorted((r["x"], r["v"]) for r in found.pixels.collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    finally:
        readers._readers.clear()
        readers._readers.update(before)


def test_axes():
    assert pixels.repaired_axes("QYX", 3) == "ZYX" and pixels.repaired_axes("YX", 4) == "CZYX" and pixels.repaired_axes("CYX", 3) == "CYX"
    assert [s for s, _ in pixels.split_axes("TCZYX", (2, 2, 5, 8, 8))] == ["_t0_c0", "_t0_c1", "_t1_c0", "_t1_c1"]
    assert [s for s, _ in pixels.split_axes("CYX", (1, 8, 8))] == [""]


def test_config_roles():
    c = Config(channel_roles={"a": "stain", "b": "stain"}, stains={"a": StainConfig(method="none")})
    assert c.stain_stems() == ["b"] and c.primary_stem() == "b"
    with pytest.raises(ValueError):
        Config(channel_roles={"a": "ghost"})


def test_calibration(spark):
    d = spark.createDataFrame([(0.1, 0.2, None, True), (0.0, 0.2, None, True), (None, 0.0, 3.0, True), (None, None, None, False)], "c double, f double, z double, s boolean")
    px = calibration.pixel_size(F.col("c"), F.col("f"))
    got = d.select(px, calibration.plane_distance(F.lit(None), F.col("z"), px, F.col("s")), calibration.source(F.col("c"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(0.1, 0.1, "config"), (0.2, 0.2, "file"), (1.0, 3.0, "fallback"), (1.0, None, "fallback")]
    units = spark.createDataFrame([("Micron",), ("parsec",), (None,)], "u string").select(calibration.unit_to_um(F.col("u"))).collect()
    assert [r[0] for r in units] == [1.0, None, None]


def test_summary_rows(spark):
    t = spark.createDataFrame([("a", 1.0, True, None), ("b", None, False, 2.0), ("c", 3.0, None, None)], "id string, v double, f boolean, w double")
    rows = {r["id"]: r for r in metrics.with_summary_rows(t, "id", True).collect()}
    assert rows["MEAN"]["v"] == 2.0 and math.isclose(rows["SEM"]["v"], 1.0) and rows["SEM"]["w"] is None and rows["MEAN"]["f"] is None
    assert metrics.without_summary_rows(metrics.with_summary_rows(t, "id"), "id").count() == 3


def test_rollup_keeps_equal_names_of_other_branches_apart(spark):
    m = spark.createDataFrame([("r/a/x", "m", 1.0), ("r/b/x", "m", 3.0), ("r", "m", None)], "path string, metric string, value double")
    got = {r["level"]: (r["n"], r["mean"], r["sem"]) for r in metrics.folder_rollup(m).collect()}
    assert got["r"] == (2, 2.0, 1.0) and got["r/a/x"] == (1, 1.0, None)


def test_histogram_closes_its_last_bin(spark):
    d = spark.createDataFrame([(0.0,), (255.0,), (254.9,), (300.0,)], "v double")
    assert {r["bin"]: r["n"] for r in metrics.histogram(d, "v", [], 255.0).collect()} == {0: 1, 127: 2}


def images(spark):
    a = np.zeros((3, 12, 24))
    for x in (4, 16):
        a[0, 4:7, x : x + 3] = 100  # nuclei
        a[1, 3:8, x - 1 : x + 4] = 50  # cytoplasm
    a[2, 5, 5] = 200  # a stain in the first
    a[2, 4:6, 20] = 200
    rows = [("s", n, 0, y, x, float(v)) for n, plane in zip(("dapi", "cyto", "gfp"), a, strict=True) for (y, x), v in np.ndenumerate(plane)]
    return spark.createDataFrame(rows, "sample_id string, channel string, z int, y int, x int, v double")


def test_whole_run(spark, tmp_path):
    config = Config(pixel_size_um=1.0, min_object_size=2, edge_margin=1, channel_roles={"dapi": "nuclear", "cyto": "cytoplasm", "gfp": "stain"}, stains={"gfp": StainConfig(min_object_size=1)}, filter_stain="gfp")
    run = batch.analyse(images(spark), config)
    cells = {r["cell_id"]: r for r in run["cells"].collect()}
    assert sorted(cells) == [1, 2] and cells[1]["N_area_um2"] == 9 and cells[1]["C_area_um2"] == 16
    assert cells[1]["stain_gfp_area_nuc_um2"] == 1 and cells[2]["stain_gfp_area_nuc_um2"] == 0 and cells[2]["stain_gfp_area_cyto_um2"] == 0
    assert [r["cell_id"] for r in run["cells_filtered"].collect()] == []  # neither reaches the mean particle
    batch.save(run, f"file://{tmp_path}/out", config)
    assert spark.read.parquet(f"file://{tmp_path}/out/metrics").select("tier").distinct().count() >= 1
    assert spark.read.json(f"file://{tmp_path}/out/sidecar").count() == 1
    paths = spark.createDataFrame([("s", "root/s")], "sample_id string, path string")
    assert batch.summaries(run, paths).where("level = 'root'").count() > 0


def test_run_with_given_labels(spark):
    config = Config(pixel_size_um=1.0, channel_roles={"dapi": "nuclear"}, remove_outliers=False)
    place = "sample_id string, z int, y int, x int, label long"
    nuclei = spark.createDataFrame([("s", 0, 5, 5, 4), ("s", 0, 5, 6, 4)], place)
    cyto = spark.createDataFrame([("s", 0, 5, 6, 9), ("s", 0, 5, 7, 9)], place)
    run = batch.analyse(images(spark), config, labels={"nuclear": nuclei, "cytoplasm": cyto})
    assert [(r["cell_id"], r["C_area_um2"], r["nuclei_in_cell"]) for r in run["cells"].collect()] == [(4, 1.0, 1)]
    assert [(r["nuc_id"], r["cyto_id"]) for r in run["mapping"].collect()] == [(4, 9)]
    assert run["labels_cytoplasm"].count() == 1


def test_stream_adds_samples_once(spark, tmp_path):
    landing, results = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "sample_id string, size double, at timestamp"
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sample_id string, size double").withColumn("at", F.lit("2020-01-01 00:10:00").cast("timestamp"))
    d.write.parquet(landing)
    for n in range(2):
        ingest.ingest(ingest.object_stream(spark, landing, schema), results, str(tmp_path / f"check{n}")).awaitTermination()
    assert spark.read.parquet(results).count() == 2
    more = d.where("sample_id = 'a'").withColumn("size", F.col("size") + 5).unionByName(d.where("sample_id = 'b'"))
    more.coalesce(1).write.mode("append").parquet(landing)  # another object of a known sample, and one again
    for check in ("check1", "check9"):
        ingest.ingest(ingest.object_stream(spark, landing, schema), results, str(tmp_path / check)).awaitTermination()
    assert sorted((r["sample_id"], r["size"]) for r in spark.read.parquet(results).collect()) == [("a", 1.0), ("a", 6.0), ("b", 2.0)]
    w = ingest.windowed_summary(d, "at", "size", []).collect()
    assert [(r["n"], r["total"]) for r in w] == [(2, 3.0)]


def test_samples_are_released_once_their_channels_are_there(spark, tmp_path):
    results, released = str(tmp_path / "objects"), str(tmp_path / "released")
    assert ingest.release(results, released, spark, ["c", "d"]).count() == 0
    add = lambda rows: spark.createDataFrame(rows, "sample_id string, channel string").write.mode("append").parquet(results)
    add([("a", "c"), ("a", "d"), ("b", "c")])
    assert [r["sample_id"] for r in ingest.release(results, released, spark, ["c", "d"]).collect()] == ["a"]
    add([("b", "d"), ("a", "c")])
    assert [r["sample_id"] for r in ingest.release(results, released, spark, ["c", "d"]).collect()] == ["b"]


def test_text_raster(spark):
    d = spark.createDataFrame([(1, "abé\nd"), (2, ""), (3, None)], "i long, t string")
    got = {(r["y"], r["x"]): r["v"] for r in pixels.from_text(d, "i", "t", 2).collect()}
    assert got == {(0, 0): 97, (0, 1): 98, (1, 0): 233, (1, 1): 10, (2, 0): 100}
