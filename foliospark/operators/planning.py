"""Whether and how a model fits a device. Sizes in gigabytes; all figures are estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Memory kept free, layers worth moving, and limits of threads, batches and context.
VRAM_MARGIN, RAM_RESERVE, CONTEXT_MARGIN, DISK_FACTOR = 1.4, 1.0, 2.0, 1.1
LEAST_LAYERS, MOST_THREADS, CPU_BATCH, GPU_BATCH, CPU_CONTEXT, LEAST_VRAM = 4, 8, 256, 512, 4096, 1.5
GB = 1024.0**3


def profile(ram: Column) -> Column:
    return F.when(ram.isNull(), "unknown").when(ram < 12, "small").when(ram < 32, "medium").otherwise("large")


def best_free_vram(gpus: Column) -> Column:
    """The most free memory of a card that isn't built in; gpus: array of (name, total, free)."""
    own = F.filter(gpus, lambda g: g["free"].isNotNull() & ~F.lower(g["name"]).rlike("intel|radeon graphics|uhd|iris|vega") & (g["total"].isNull() | (g["total"] >= LEAST_VRAM)))
    return F.array_max(F.transform(own, lambda g: g["free"]))


def gpu_layers(offload: Column, free: Column, needed: Column, layers: Column) -> Column:
    """-1 for all, 0 for none, else the layers that fit."""
    budget = free - VRAM_MARGIN
    some = F.floor(layers * budget / needed).cast("int")
    return (
        F.when(~offload | free.isNull() | needed.isNull() | (needed <= 0), 0)
        .when(free >= needed + VRAM_MARGIN, -1)
        .when(layers.isNull() | (layers <= 0) | (budget <= 0) | (some < LEAST_LAYERS), 0)
        .otherwise(F.least(layers, some))
    )


def threads(cores: Column) -> Column:
    own = F.greatest(F.coalesce(cores, F.lit(2)), F.lit(1))
    return F.when(own <= 2, own).otherwise(F.greatest(F.lit(1), F.least(F.lit(MOST_THREADS), own - 1)))


def context(default: Column, layers: Column, needed_ram: Column, ram: Column) -> Column:
    own = F.greatest(F.lit(512), F.coalesce(default, F.lit(CPU_CONTEXT)))
    tight = needed_ram.isNotNull() & ram.isNotNull() & (ram < needed_ram + CONTEXT_MARGIN)
    return F.when((layers == 0) | tight, F.least(own, F.lit(CPU_CONTEXT))).otherwise(own)


def verdict(device: DataFrame) -> Column:
    """Of a row with a model's and a device's columns."""
    disk = F.col("size_bytes") / F.lit(GB) * DISK_FACTOR
    return (
        F.when(F.col("disk_free").isNull(), "unknown")
        .when(F.col("disk_free") < disk, "no")
        .when(F.col("ram_total").isNull(), "unknown")
        .when(~F.col("runtime"), "runtime_missing")
        .when(F.col("ram_total") < F.col("estimated_ram_gb") + RAM_RESERVE, "no")
        .otherwise("cpu_unverified")
    )


def placements(models: DataFrame, devices: DataFrame) -> DataFrame:
    """Plan of each model on each device; devices are a person's few."""
    both = models.join(F.broadcast(devices), how="cross").withColumn("free_vram", best_free_vram(F.col("gpus")))
    both = both.withColumn("layers", gpu_layers(F.col("offload"), F.col("free_vram"), F.col("estimated_vram_gb"), F.col("layer_count")))
    return both.select("device", "model_id", "filename", verdict(both).alias("verdict"), "layers", threads(F.col("cores")).alias("threads"), F.when(F.col("layers") != 0, GPU_BATCH).otherwise(CPU_BATCH).alias("batch"), context(F.lit(8192), F.col("layers"), F.col("estimated_ram_gb"), F.col("ram_total")).alias("context"))


def recommended(models: DataFrame, devices: DataFrame) -> DataFrame:
    """The largest model that fits each device's memory and disk, else the smallest."""
    both = models.where("status = 'available' AND estimated_ram_gb IS NOT NULL").join(F.broadcast(devices), how="cross")
    fits = F.coalesce(F.col("ram_total") >= F.col("estimated_ram_gb") + RAM_RESERVE, F.lit(False)) & F.coalesce(F.col("disk_free") >= F.floor(F.col("size_bytes") * DISK_FACTOR) / F.lit(GB), F.lit(False))
    order = Window.partitionBy("device").orderBy(F.desc("fits"), F.when(F.col("fits"), -F.col("estimated_ram_gb")).otherwise(F.col("estimated_ram_gb")), "filename", "model_id")
    return both.withColumn("fits", fits).withColumn("n", F.row_number().over(order)).where("n = 1").select("device", "model_id", "filename", "fits")


def setup(models: DataFrame, devices: DataFrame, installed: DataFrame) -> DataFrame:
    """What to do on each device: ready if a model is there, download the best that fits, else skip."""
    have = models.join(installed, "model_id", "left_semi").agg(F.max_by("model_id", F.struct("estimated_ram_gb", "filename", "model_id")).alias("have"))
    choice = recommended(models, devices).where("fits").select("device", F.col("model_id").alias("best"))
    rows = devices.select("device").crossJoin(F.broadcast(have)).join(choice, "device", "left")
    return rows.select("device", F.when(F.col("have").isNotNull(), "ready").when(F.col("best").isNotNull(), "download").otherwise("skip").alias("action"), F.coalesce("have", "best").alias("model_id"))
