"""Peak and landmark operators over long tables, as window functions and bucketed range joins.

The Arrow front-ends in ``spectral`` do the same in one pass per recording; these serve spectrograms and peaks
that are tables already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorel.functions import columns as C

REC = "recording_id"


def rolling_max_2d(spectrogram: DataFrame, half_t: int, half_f: int) -> DataFrame:
    """recording_id, t, f, v with ``m``: the maximum within half_t frames and half_f bins. Separable: over bins,
    then over frames."""
    over_f = Window.partitionBy(REC, "t").orderBy("f").rangeBetween(-half_f, half_f)
    over_t = Window.partitionBy(REC, "f").orderBy("t").rangeBetween(-half_t, half_t)
    return spectrogram.withColumn("m", F.max("v").over(over_f)).withColumn("m", F.max("m").over(over_t))


def pick_peaks(spectrogram: DataFrame, half_t: int, half_f: int, floor: float, linear: float | None = None) -> DataFrame:
    """recording_id, t, f, mag of local maxima above the floor (and above ``linear``); all cells of a plateau count."""
    cond = (F.col("v") > floor) & (F.col("v") >= F.col("m"))
    if linear is not None:
        cond &= F.col("v") > linear
    return rolling_max_2d(spectrogram, half_t, half_f).filter(cond).select(REC, "t", "f", F.col("v").alias("mag"))


def cap_per_second(peaks: DataFrame, most: int, fps: float) -> DataFrame:
    """The strongest ``most`` peaks of each second, ties to the earlier and lower; 0 keeps all."""
    if most == 0:
        return peaks
    w = Window.partitionBy(REC, F.floor(F.col("t") / F.lit(fps))).orderBy(F.desc("mag"), "t", "f")
    return peaks.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")


def _targets(peaks: DataFrame, zone_t: int, zone_f: int) -> DataFrame:
    """Anchor-target rows with 1 <= dt <= zone_t and |df| <= zone_f: an equi-join on time buckets as wide as the
    zone, where each anchor looks into its own and the next bucket."""
    a = peaks.select(REC, F.col("t").alias("ta"), F.col("f").alias("fa"), F.col("mag").alias("ma"))
    own = F.floor(F.col("ta") / zone_t)
    a = a.withColumn("bucket", F.explode(F.array(own, own + 1)))
    b = peaks.select(REC, F.col("t").alias("tb"), F.col("f").alias("fb"), F.col("mag").alias("mb"), F.floor(F.col("t") / zone_t).alias("bucket"))
    return a.join(b, [REC, "bucket"]).filter((F.col("tb") - F.col("ta")).between(1, zone_t) & (F.abs(F.col("fb") - F.col("fa")) <= zone_f)).drop("bucket")


def wang_pairs(peaks: DataFrame, zone_t: int = 63, zone_f: int = 64, fan_out: int = 10) -> DataFrame:
    """Each anchor with its strongest targets, ties to the earlier and lower, and the pair's hash."""
    w = Window.partitionBy(REC, "ta", "fa").orderBy(F.desc("mb"), "tb", "fb")
    top = _targets(peaks, zone_t, zone_f).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fan_out).drop("r")
    return top.withColumn("hash", C.wang_hash(F.col("fa"), F.col("fb"), F.col("tb") - F.col("ta")))


def wang_hashes(peaks: DataFrame, zone_t: int = 63, zone_f: int = 64, fan_out: int = 10) -> DataFrame:
    return wang_pairs(peaks, zone_t, zone_f, fan_out).select(REC, "hash", F.col("ta").alias("t_anchor"))


def panako_triplets(peaks: DataFrame, zone_t: int = 96, zone_f: int = 96, fan_out: int = 5) -> DataFrame:
    """Each anchor with the pairs of targets (b before c in time and bin) of the largest summed magnitude.

    Only an anchor's strongest fan_out + 1 targets, with all ties of the last, can be in its best pairs, so the
    pairs of one anchor stay few.
    """
    strong = Window.partitionBy(REC, "ta", "fa").orderBy(F.desc("mb"))
    key = [REC, "ta", "fa", "ma"]
    some = _targets(peaks, zone_t - 1, zone_f - 1).withColumn("k", F.rank().over(strong)).filter(F.col("k") <= fan_out + 1)
    sets = some.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("tb", "fb", "mb"))).alias("s"))
    pairs = sets.select(*key, "s", F.posexplode("s").alias("i", "b")).select(*key, "b", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("c"))
    total = (F.col("b.mb").cast("float") + F.col("c.mb").cast("float")).cast("float")
    w = Window.partitionBy(REC, "ta", "fa").orderBy(F.desc("total"), "b.tb", "b.fb", "c.tb", "c.fb")
    top = pairs.withColumn("total", total).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fan_out)
    out = top.select(*key, *[F.col(f"b.{x}b").alias(f"{x}b") for x in "tfm"], *[F.col(f"c.{x}b").alias(f"{x}c") for x in "tfm"])
    return out.withColumn("hash", C.panako_hash(*[F.col(x) for x in ("fa", "fb", "fc", "ma", "mb", "mc", "ta", "tb", "tc")]))


def panako_hashes(peaks: DataFrame, zone_t: int = 96, zone_f: int = 96, fan_out: int = 5) -> DataFrame:
    return panako_triplets(peaks, zone_t, zone_f, fan_out).select(REC, "hash", F.col("ta").alias("t_anchor"), F.col("tb").alias("t_b"), F.col("tc").alias("t_c"))


def haitsma_bands(spectrogram: DataFrame, bands: DataFrame) -> DataFrame:
    """Energy of each band: spectrogram (recording_id, t, f, v) with the fixed table (f, band)."""
    return spectrogram.join(F.broadcast(bands), "f").groupBy(REC, "t", "band").agg(F.sum("v").alias("e"))


def haitsma_frames(energies: DataFrame, bits: int = 32) -> DataFrame:
    """recording_id, pos, frame from (recording_id, t, band, e): sign bits of the change of band differences, band 0
    in the highest bit. Bands without bins hold no energy."""
    some = energies.groupBy(REC, "t").agg(F.map_from_entries(F.collect_list(F.struct("band", "e"))).alias("m"))
    at = lambda k: F.coalesce(F.element_at("m", F.lit(k).cast("bigint")), F.lit(0.0))
    diffs = some.select(REC, "t", F.array(*[at(b) - at(b + 1) for b in range(bits)]).alias("d"))
    before = diffs.withColumn("p", F.lag("d").over(Window.partitionBy(REC).orderBy("t"))).filter(F.col("p").isNotNull())
    code = F.lit(0).cast("bigint")
    for b in range(bits):
        code = code.bitwiseOR(F.when(F.get("d", F.lit(b)) - F.get("p", F.lit(b)) > 0, F.lit(1 << (bits - 1 - b)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return before.select(REC, (F.col("t") - 1).alias("pos"), code.alias("frame"))
