"""Document profile, limit flags, recommendations and optimisation routing.

``document_profile`` is one aggregation of the page table grouped by ``doc_id`` (partial
aggregation runs map-side, so a document with very many pages adds no skew to the
shuffle), followed by one join to the file listing. Documents without pages survive
through the left join with zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.constants import (
    FILE_SIZE_LIMIT_MB,
    FILE_SIZE_WARNING_MB,
    IMAGE_HEAVY_PAGE_LIMIT,
    OPTIMIZE_IMAGE_THRESHOLD,
    OPTIMIZE_SIZE_THRESHOLD_MB,
    PAGE_TEXT_LIMIT,
    RECOMMEND_FILE_SIZE,
    RECOMMEND_REMOVE_IMAGES,
    RECOMMEND_TEXT_LIMIT_FMT,
)

MB = 1024.0 * 1024.0


def bytes_to_mb(c: Column) -> Column:
    return c / 1024.0 / 1024.0


def page_profile(pages: DataFrame, text_limit: int = PAGE_TEXT_LIMIT) -> DataFrame:
    """Per page: doc_id, page, images, text_length, exceeds_64kb (text_length > limit)."""
    text_length = F.length("text")
    return pages.select(
        "doc_id", F.col("page_no").alias("page"), F.col("images").cast("int").alias("images"),
        text_length.alias("text_length"), (text_length > F.lit(text_limit)).alias("exceeds_64kb"))


def _page_aggregates(pages: DataFrame, text_limit: int, include_page_details: bool) -> DataFrame:
    text_length = F.length("text")
    aggs = [
        F.count("*").alias("total_pages"),
        F.sum("images").cast("bigint").alias("total_images"),
        F.count_if(F.col("images") > 0).alias("pages_with_images"),
        F.count_if(text_length > F.lit(text_limit)).alias("pages_exceeding_text_limit"),
        F.bool_or(F.col("images") > IMAGE_HEAVY_PAGE_LIMIT).alias("has_image_heavy_pages"),
    ]
    if include_page_details:
        # One array per document: bounded by that document's page count. Off by default.
        detail = F.struct(F.col("page_no").alias("page"), F.col("images").cast("int").alias("images"),
                          text_length.alias("text_length"), (text_length > F.lit(text_limit)).alias("exceeds_64kb"))
        aggs.append(F.array_sort(F.collect_list(detail)).alias("page_details"))
    return pages.groupBy("doc_id").agg(*aggs)


def document_profile(pages: DataFrame, files: DataFrame, text_limit: int = PAGE_TEXT_LIMIT,
                     include_page_details: bool = False) -> DataFrame:
    """One row per file: sizes, page/image counts, limit flags and recommendations.

    ``pages``: doc_id, page_no, text, images. ``files``: doc_id, file_size_bytes.
    """
    agg = _page_aggregates(pages, text_limit, include_page_details)
    joined = files.select("doc_id", "file_size_bytes").join(agg, "doc_id", "left")
    total_pages = F.coalesce(F.col("total_pages"), F.lit(0).cast("bigint"))
    total_images = F.coalesce(F.col("total_images"), F.lit(0).cast("bigint"))
    over_limit = F.coalesce(F.col("pages_exceeding_text_limit"), F.lit(0).cast("bigint"))
    size_mb = bytes_to_mb(F.col("file_size_bytes"))
    cols = [
        "doc_id",
        size_mb.alias("file_size_mb"),
        total_pages.alias("total_pages"),
        total_images.alias("total_images"),
        F.coalesce(F.try_divide(total_images, total_pages), F.lit(0.0)).alias("avg_images_per_page"),
        F.coalesce(F.col("pages_with_images"), F.lit(0).cast("bigint")).alias("pages_with_images"),
        over_limit.alias("pages_exceeding_text_limit"),
        F.struct(
            (size_mb > FILE_SIZE_LIMIT_MB).alias("file_size"),
            F.coalesce(F.col("has_image_heavy_pages"), F.lit(False)).alias("has_image_heavy_pages"),
            (over_limit > 0).alias("has_text_heavy_pages"),
        ).alias("exceeds_limits"),
        F.array_compact(F.array(
            F.when(total_images > 0, F.lit(RECOMMEND_REMOVE_IMAGES)),
            F.when(size_mb > FILE_SIZE_WARNING_MB, F.lit(RECOMMEND_FILE_SIZE)),
            F.when(over_limit > 0, F.format_string(RECOMMEND_TEXT_LIMIT_FMT, over_limit)),
        )).alias("recommendations"),
    ]
    if include_page_details:
        cols.append(F.coalesce(F.col("page_details"), F.array().cast(
            "array<struct<page:int,images:int,text_length:int,exceeds_64kb:boolean>>")).alias("page_details"))
    return joined.select(*cols)


def should_optimize(profile: DataFrame, size_threshold_mb: float = OPTIMIZE_SIZE_THRESHOLD_MB) -> Column:
    """Large file, many images, or any limit flag. A missing profile value counts as False."""
    lim = F.col("exceeds_limits")
    decision = ((F.col("file_size_mb") > size_threshold_mb)
                | (F.col("total_images") > OPTIMIZE_IMAGE_THRESHOLD)
                | lim["file_size"] | lim["has_image_heavy_pages"] | lim["has_text_heavy_pages"])
    return F.coalesce(decision, F.lit(False))


def optimize_routing(profile: DataFrame, skip_optimization: Column | bool = False,
                     keep_images: Column | bool = False,
                     size_threshold_mb: float = OPTIMIZE_SIZE_THRESHOLD_MB) -> DataFrame:
    """Adds ``should_optimize`` and ``route`` in {skipped, remove_images, compress_only}."""
    skip = skip_optimization if isinstance(skip_optimization, Column) else F.lit(bool(skip_optimization))
    keep = keep_images if isinstance(keep_images, Column) else F.lit(bool(keep_images))
    out = profile.withColumn("should_optimize", should_optimize(profile, size_threshold_mb))
    route = (F.when(skip | ~F.col("should_optimize"), F.lit("skipped"))
             .when(keep, F.lit("compress_only"))
             .otherwise(F.lit("remove_images")))
    return out.withColumn("route", route)


def size_reduction(files: DataFrame) -> DataFrame:
    """Original and optimised size in MB and the reduction in percent.

    A zero original size makes the reduction NULL and the status ``error``, as the
    division fails in the original tool. ``size_reduction`` is the display string
    (``%.1f%%`` with half-even rounding, or ``N/A``).
    """
    orig = F.col("file_size_bytes").cast("double")
    opt = F.col("optimized_size_bytes").cast("double")
    pct = F.try_divide(orig - opt, orig) * 100.0
    return files.select(
        "doc_id",
        bytes_to_mb(orig).alias("original_size_mb"),
        bytes_to_mb(opt).alias("optimized_size_mb"),
        pct.alias("size_reduction_percent"),
        F.when(pct.isNotNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
        F.when(pct.isNotNull(), F.format_string("%.1f%%", F.bround(pct, 1))).otherwise(F.lit("N/A"))
        .alias("size_reduction"),
    )


def optimization_counters(routed: DataFrame) -> DataFrame:
    """Images removed and pages processed per document (0 images for compress_only/skipped)."""
    removes = F.col("route") == "remove_images"
    return routed.select(
        "doc_id", "route",
        F.when(removes, F.col("total_images")).otherwise(F.lit(0).cast("bigint")).alias("images_removed"),
        F.when(F.col("route") != "skipped", F.col("total_pages")).otherwise(F.lit(0).cast("bigint")).alias("pages_processed"),
    )
