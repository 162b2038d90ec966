"""One explicit schema per table; nothing is inferred."""

from pyspark.sql import types as T

LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
])

CLIPS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("cam_index", T.IntegerType()),
    T.StructField("date", T.StringType()),
    T.StructField("file_start_time", T.StringType()),
    T.StructField("file_end_time", T.StringType()),
    T.StructField("file_duration", T.DoubleType()),
    T.StructField("prescreen_status", T.StringType()),
    T.StructField("prescreen_result", T.StringType()),
    T.StructField("analysis_status", T.StringType()),
    T.StructField("analysis_segments", T.StringType()),
    T.StructField("has_audio", T.BooleanType()),
    T.StructField("updated_at", T.TimestampType()),
])

DAY_STATUS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("cam_index", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("output_file", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

FRAMES = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("offset_s", T.DoubleType()),
    T.StructField("pixels", T.ArrayType(T.IntegerType())),
])

ENERGIES = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("k", T.LongType()),
    T.StructField("energy", T.DoubleType()),
])

SEGMENT = T.StructType([
    T.StructField("start_time", T.DoubleType()),
    T.StructField("end_time", T.DoubleType()),
    T.StructField("state", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("file_start_offset", T.DoubleType()),
    T.StructField("max_energy", T.DoubleType()),
])

SEGMENT_LIST = T.ArrayType(SEGMENT)

PRESCREEN_DETAIL = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("sample_ts", T.ArrayType(T.DoubleType())),
    T.StructField("diffs", T.ArrayType(T.DoubleType())),
    T.StructField("max_diff", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("mean_luma", T.DoubleType()),
    T.StructField("early_stop", T.BooleanType()),
    T.StructField("checked_pairs", T.LongType()),
    T.StructField("sample_fps", T.DoubleType()),
])

DETECTIONS = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("class_id", T.IntegerType()),
    T.StructField("conf", T.DoubleType()),
])

OP_METRICS = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("gpu", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("frames", T.LongType()),
    T.StructField("fps", T.DoubleType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])
