"""Label relations to TIFF masks: a data sink that shows a file only when the whole job has ended well.

Each image is written row by row by one task, whatever its size, from rows in raster order; files
are written under another name and renamed when all tasks are done, so a failed or repeated task
leaves nothing that a reader could find.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lumenframe.sources.ranges import located
from lumenframe.sources.tiff import layout

FORMAT = "lumenframe_masks"
SCHEMA = "file string, z int, y int, x int, label bigint, depth int, height int, width int, most bigint, px double, pz double"
FULL = 255  # of a binary mask


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # where a file is, and its name


class Image:
    """One file in the making: planes row by row, what lies between given pixels is 0."""

    def __init__(self, system, path: str, depth: int, height: int, width: int, most: int, px: float | None, pz: float | None):
        self.shape = (depth, height, width)
        self.dtype = np.dtype("u1" if most < 0 else "<u2" if most <= 0xFFFF else "<u4")  # a binary mask has no greatest label
        self.stream = system.open_output_stream(path)
        before, self.after = layout(self.shape, self.dtype, px, pz, "micron")
        self.stream.write(before)
        self.at, self.row = 0, np.zeros(width, self.dtype)

    def add(self, row: int, x: np.ndarray, label: np.ndarray) -> None:
        """Pixels of a row, counted through all planes; rows come in order."""
        if row != self.at:
            self.skip(row)
        self.row[x] = label

    def skip(self, row: int) -> None:
        self.stream.write(self.row.tobytes())
        self.row[:] = 0
        zeros = self.row.tobytes()
        for _ in range(self.at + 1, row):
            self.stream.write(zeros)
        self.at = row

    def close(self) -> None:
        self.skip(self.shape[0] * self.shape[1])
        self.stream.write(self.after)
        self.stream.close()


class MaskWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.stage = f"{self.folder}/.stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, stage = located(self.stage)
        done, image, name = Written(), None, None
        for batch in iterator:
            v = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            files = v["file"].to_pylist()
            number = {c: v[c].fill_null(0).to_numpy() for c in ("z", "y", "x", "label")}
            shown = v["label"].is_valid().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(files):
                to = at + next((i for i, f in enumerate(files[at:]) if f != files[at]), len(files) - at)
                if files[at] != name:
                    if image:
                        image.close()
                    name, place = files[at], f"{stage}/{uuid.uuid4().hex}.tif"
                    system.create_dir(stage)
                    depth, height, width, most = (v[c][at].as_py() for c in ("depth", "height", "width", "most"))
                    image = Image(system, place, depth, height, width, most, v["px"][at].as_py(), v["pz"][at].as_py())
                    done.files.append((place, f"{located(self.folder)[1]}/{name}"))
                own = at + np.flatnonzero(shown[at:to])
                rows = number["z"][own].astype(np.int64) * image.shape[1] + number["y"][own]
                cuts = np.flatnonzero(np.diff(rows, prepend=-1, append=-1)) if len(rows) else []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    image.add(int(rows[a]), number["x"][own[a:b]], number["label"][own[a:b]])
                at = to
        if image:
            image.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = located(self.folder)
        for place, name in (f for m in messages if m for f in m.files):
            system.create_dir(name.rsplit("/", 1)[0])
            system.move(place, name)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        import pyarrow.fs as fs

        system, stage = located(self.stage)
        if system.get_file_info(stage).type != fs.FileType.NotFound:
            system.delete_dir(stage)


class MaskSink(DataSource):
    """``df.write.format("lumenframe_masks").mode("append").save(folder)`` of rows in SCHEMA, sorted within partitions by file and place."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> MaskWriter:
        return MaskWriter(self.options["path"])


def write_masks(labels: DataFrame, pixels: DataFrame, folder: str, name: str, scale: DataFrame | None = None, binary_only: bool = False) -> None:
    """Masks of every sample of ``pixels`` below ``folder``: ``<sample_id>/<name>_labeled.tif`` and ``<name>_binary.tif`` (0 and 255), or the latter only.

    labels(sample_id, z, y, x, label); a sample without objects has masks of zeros. Labels are of 2
    bytes, or of 4 where one is over 65535. scale(sample_id, px, pz) is stated in the files. A
    sample_id that is a path names folders.
    """
    spark = labels.sparkSession
    spark.dataSource.register(MaskSink)
    frames = pixels.groupBy("sample_id").agg(*[(F.max(c) + 1).cast("int").alias(n) for c, n in (("z", "depth"), ("y", "height"), ("x", "width"))])
    most = labels.groupBy("sample_id").agg(F.max("label").alias("most"))
    frames = frames.join(most, "sample_id", "left").fillna(0, ["most"])
    if scale is None:
        frames = frames.withColumns({"px": F.lit(None).cast("double"), "pz": F.lit(None).cast("double")})
    else:
        frames = frames.join(scale.select("sample_id", "px", "pz"), "sample_id", "left")
    marked = labels.select("sample_id", "z", "y", "x", F.col("label").cast("long").alias("label"))
    every = marked.unionByName(frames.select("sample_id", *[F.lit(0).alias(c) for c in "zyx"], F.lit(None).cast("long").alias("label")))
    kinds = [("binary", F.when(F.col("label").isNotNull(), F.lit(FULL)), F.lit(-1))] + ([] if binary_only else [("labeled", F.col("label"), F.col("most"))])
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("v"), m.cast("long").alias("m")) for k, v, m in kinds])).alias("k")
    rows = every.join(frames, "sample_id").select("*", kind)
    file = F.concat(F.col("sample_id").cast("string"), F.lit(f"/{name}_"), F.col("k.kind"), F.lit(".tif"))
    out = rows.select(file.alias("file"), "z", "y", "x", F.col("k.v").alias("label"), "depth", "height", "width", F.col("k.m").alias("most"), "px", "pz")
    out = out.repartition("file").sortWithinPartitions("file", "z", "y", "x", F.col("label").asc_nulls_first())
    out.write.format(FORMAT).mode("append").save(folder)
