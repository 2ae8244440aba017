"""Crop geometry, crop voxels, names of detections and intensity scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.checkpoints import cut

AXES = ("z", "x", "y")


def _crop(centres: dict[str, Column], shape: tuple[int, int, int], target: tuple[int, int, int]) -> list[Column]:
    bounds, pads = [], []
    for axis, dim, size in zip(AXES, shape, target, strict=True):
        half = size // 2
        lo = F.greatest(F.least(centres[axis] - half, F.lit(dim)), F.lit(0))
        hi = F.least(F.greatest(F.least(centres[axis] + half, F.lit(dim)), F.lit(0)), lo + size)
        bounds += [lo.cast("int").alias(f"{axis}0"), hi.cast("int").alias(f"{axis}1")]
        pads.append(F.greatest(F.lit(size) - (hi - lo), F.lit(0)).cast("int").alias(f"pad{axis}"))
    return [*bounds, *pads]


def with_position(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("z").isNotNull() & ~F.isnan("z"))


def crop_bounds(detections: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """linear_ind, z0..y1 and the zeros to put before each axis, around centroids rounded half to even.

    Detections without a position are left out.
    """
    centres = {a: F.bround(F.col(a), 0).cast("int") for a in AXES}
    return with_position(detections).select("linear_ind", *_crop(centres, shape, target))


def crop_bounds_bbox(boxes: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """The same around the truncated middle of boxes (bz0, bx0, by0, bz1, bx1, by1)."""
    centres = {a: ((F.col(f"b{a}0") + F.col(f"b{a}1")) / 2).cast("int") for a in AXES}
    return boxes.select("linear_ind", *_crop(centres, shape, target))


_CHUNK = "t int, cz int, cx int, cy int, voxels array<float>"


def chunked(volumes: DataFrame, shape: tuple[int, int, int], chunk: tuple[int, int, int]) -> DataFrame:
    """t, cz, cx, cy, voxels: volumes (t, voxels flat by z, x, y) as chunks by their place in the grid,
    flat too; the last ones of an axis may be smaller."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            for t, flat in zip(batch.column(0).to_pylist(), batch.column(1)):
                volume = flat.values.to_numpy(zero_copy_only=False).reshape(shape)
                out = [], [], [], [], []
                for at in np.ndindex(*(-(-n // c) for n, c in zip(shape, chunk, strict=True))):
                    part = volume[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk, strict=True))]
                    for column, value in zip(out, (t, *at, part.ravel().astype("float32")), strict=True):
                        column.append(value)
                kinds = (*[pa.int32()] * 4, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["t", "cz", "cx", "cy", "voxels"])

    return volumes.select(F.col("t").cast("int").alias("t"), F.col("voxels").cast("array<float>").alias("voxels")).mapInArrow(run, _CHUNK)


def crop_voxels(bounds: DataFrame, chunks: DataFrame, shape: tuple[int, int, int], chunk: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """linear_ind and voxels, the crop of a frame's volume with zeros at the start of each axis, flat.

    chunks: chunked's table of volumes of a shape. bounds has t too. A crop meets the chunks that it
    touches by their place, its part of each is cut out there, and only the parts travel to the crop:
    no row holds a volume. A voxel outside the padded crop, and of a chunk that is missing, is 0.
    """
    import pyarrow as pa

    size = target[0] * target[1] * target[2]
    need = bounds
    for a, c in zip(AXES, chunk, strict=True):
        first, last = F.floor(F.col(f"{a}0") / c).cast("int"), F.floor((F.col(f"{a}1") - 1) / c).cast("int")
        # an empty range meets no chunk, and leaves its crop without parts
        need = need.withColumn(f"c{a}", F.explode_outer(F.when(F.col(f"{a}1") > F.col(f"{a}0"), F.sequence(first, last))))
    edges = [f"{a}{e}" for a in AXES for e in (0, 1)]
    met = need.join(chunks, ["t", "cz", "cx", "cy"], "left").select("linear_ind", *edges, *(f"pad{a}" for a in AXES), "cz", "cx", "cy", "voxels")

    def part(batches):
        """Places within the crop and voxels of what a crop and a chunk share."""
        import numpy as np

        for batch in batches:
            rows = batch.drop_columns(["voxels"]).to_pylist()
            places, held = [], []
            for row, flat in zip(rows, batch.column(batch.num_columns - 1)):
                if not flat.is_valid:
                    places.append([])
                    held.append([])
                    continue
                start = [row[f"c{a}"] * c for a, c in zip(AXES, chunk, strict=True)]
                extent = [min(c, n - s) for c, n, s in zip(chunk, shape, start, strict=True)]
                values = flat.values.to_numpy(zero_copy_only=False).reshape(extent)
                lo = [max(row[f"{a}0"], s) for a, s in zip(AXES, start, strict=True)]
                hi = [min(row[f"{a}1"], s + e) for a, s, e in zip(AXES, start, extent, strict=True)]
                to = [np.arange(x, y) - row[f"{a}0"] + row[f"pad{a}"] for a, x, y in zip(AXES, lo, hi, strict=True)]
                inside = [t < n for t, n in zip(to, target, strict=True)]
                grid = np.ix_(*(t[i] for t, i in zip(to, inside, strict=True)))
                cut_out = values[np.ix_(*(np.arange(x, y)[i] - s for x, y, s, i in zip(lo, hi, start, inside, strict=True)))]
                places.append(((grid[0] * target[1] + grid[1]) * target[2] + grid[2]).ravel())
                held.append(cut_out.ravel())
            columns = [batch.column(0).cast(pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["linear_ind", "place", "v"])

    def whole(batches):
        import numpy as np

        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                crop = np.zeros(size, dtype="float32")
                for p in parts:
                    crop[np.array(p["place"], dtype=np.int64)] = p["v"]
                out.append(crop)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["linear_ind", "voxels"])

    parts = met.mapInArrow(part, "linear_ind bigint, place array<int>, v array<float>")
    gathered = parts.groupBy("linear_ind").agg(F.collect_list(F.struct("place", "v")).alias("parts"))  # a crop's voxels at most
    return gathered.mapInArrow(whole, "linear_ind bigint, voxels array<float>")


def detection_names(detections: DataFrame, tracks: DataFrame, include_untracked: bool = True) -> DataFrame:
    """linear_ind and obj_name: the track's name, else one made of frame and ids, or no row."""
    rows = detections.join(tracks.select("linear_ind", "name"), "linear_ind", "left" if include_untracked else "inner")
    own = F.format_string("untracked_time_%d_%04d_%04d", "t", "raw_neuron_ind", "raw_seg_id")
    named = F.when(F.col("name").isNotNull(), F.format_string("neuron_%03d", "name"))
    return rows.select("linear_ind", named.otherwise(own).alias("obj_name"))


def parse_untracked_name(names: DataFrame) -> DataFrame:
    """obj_name, raw_neuron_ind and raw_seg_id of synthetic names."""
    part = lambda i: F.element_at(F.split("obj_name", "_"), i).cast("int")
    return names.where(F.col("obj_name").startswith("untracked_")).select("obj_name", part(-2).alias("raw_neuron_ind"), part(-1).alias("raw_seg_id"))


def pivot_frame(detections: DataFrame, frame: int, names: list[int]) -> DataFrame:
    """One row: t and a column n<name> with the greatest z of each name in the frame."""
    wide = detections.where(F.col("t") == frame).groupBy("t").pivot("gt_label", names).agg(F.max("z"))
    return wide.select("t", *[F.col(str(n)).alias(f"n{n}") for n in names])


def names_by_segment(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """linear_ind and name of detections by frame and segment; of several names on one segment the last counts."""
    last = tracks.groupBy("t", "raw_seg_id").agg(F.max("name").alias("name"))
    return detections.select("linear_ind", "t", "raw_seg_id").join(last, ["t", "raw_seg_id"], "left").select("linear_ind", "name")


def raw_index(points: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """linear_ind and raw_neuron_ind by two maps (linear_ind, raw_neuron_ind), the first before the second; null in neither."""
    a, b = (df.select("linear_ind", F.col("raw_neuron_ind").alias(name)) for df, name in ((first, "_a"), (second, "_b")))
    return points.select("linear_ind").join(a, "linear_ind", "left").join(b, "linear_ind", "left").select("linear_ind", F.coalesce("_a", "_b").alias("raw_neuron_ind"))


#: Bins of a round of selection, and values in a bin that are ranked by themselves.
BINS, FEW = 1024, 4096
#: Stacks whose bounds are broadcast, at most; more are shuffled.
BROADCAST_STACKS = 100_000


def ranked_values(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """_by, r, v: the r-th smallest value (from 0) of each stack. values: _by, v; ranks: _by, r.

    Exact, by rounds: a histogram of the range that holds a rank, then of the bin that holds it, until
    the bin holds one value or a FEW, which are ranked. No task holds a stack.
    """
    few = ranks.count() <= BROADCAST_STACKS
    meet = lambda state: values.join(F.broadcast(state) if few else state, "_by").where(F.col("v").between(F.col("lo"), F.col("hi")))
    whole = values.groupBy("_by").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    state = cut(ranks.join(whole, "_by").withColumn("before", F.lit(0).cast("bigint")))
    while not state.where((F.col("lo") < F.col("hi")) & (F.col("n") > FEW)).isEmpty():
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        wide = meet(state.where((F.col("lo") < F.col("hi")) & (F.col("n") > FEW)))
        bins = wide.groupBy("_by", "r", "before", place.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy("_by", "r").orderBy("bin"))  # at most BINS rows
        found = bins.withColumn("upto", F.col("before") + upto).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))
        found = found.select("_by", "r", "lo", "hi", "n", (F.col("upto") - F.col("n")).alias("before"))
        state = cut(state.where((F.col("lo") >= F.col("hi")) | (F.col("n") <= FEW)).unionByName(found))
    some = meet(state.where("lo < hi")).withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("_by", "r").orderBy("v")) - 1)
    return state.where("lo = hi").select("_by", "r", F.col("lo").alias("v")).unionByName(some.where("at = r").select("_by", "r", "v"))


def rescale_intensity(values: DataFrame, lower: float = 0.05, by: str = "linear_ind") -> DataFrame:
    """linear_ind, pos and val of an array column vals: clipped below the lower percentile (linear
    interpolation) of its stack, the rows of one by, then stretched from 0 to 1; all 0 where the range is 0.

    The percentile lies between two ranked values, which are selected exactly in rounds, see
    ranked_values. Null values count in no stack and stay null.
    """
    flat = cut(values.select(F.col(by).alias("_by"), "linear_ind", F.posexplode("vals").alias("pos", "v")))
    there = flat.where("v is not null").select("_by", "v")
    sizes = cut(there.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("hi")).withColumn("h", lower * (F.col("n") - 1)))
    below = F.floor("h").cast("bigint")
    ranks = sizes.select("_by", F.explode(F.array_distinct(F.array(below, F.ceil("h").cast("bigint")))).alias("r"))
    ends = ranked_values(there, ranks).groupBy("_by").agg(F.min("v").alias("v0"), F.max("v").alias("v1"))
    bounds = sizes.join(ends, "_by").select("_by", "hi", (F.col("v0") + (F.col("h") - below) * (F.col("v1") - F.col("v0"))).alias("lo"))
    span = F.col("hi") - F.col("lo")
    val = F.when(span > 0, (F.greatest("v", "lo") - F.col("lo")) / span).otherwise(F.lit(0.0))
    val = F.when(F.col("v").isNotNull(), val)
    return flat.join(bounds, "_by", "left").select("linear_ind", F.col("pos").cast("int").alias("pos"), val.alias("val"))
