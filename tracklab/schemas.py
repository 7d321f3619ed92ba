"""Declared schemas of the file inputs."""

SCORE_CSV = (
    "arm STRING, seed INT, i INT, cls STRING, offset DOUBLE, heading DOUBLE, mL DOUBLE, mR DOUBLE, mc DOUBLE, "
    "n_base INT, adj INT, flags STRING"
)
FRAME = (
    "STRUCT<i: INT, timestamp_ns: BIGINT, t_offset_s: DOUBLE, x: DOUBLE, y: DOUBLE, speed: DOUBLE, corridor: INT, "
    "pass_id: INT, contaminated: BOOLEAN, stationary: BOOLEAN, headland: BOOLEAN, eligible: BOOLEAN, split: STRING, "
    "subsample_1p5m: BOOLEAN>"
)
MANIFEST_FILE = f"meta STRUCT<bag: STRING>, frames ARRAY<{FRAME}>"
ANNOTATION_FILE = (
    "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, height: INT, width: INT>>, "
    "annotations ARRAY<STRUCT<image_id: BIGINT, category_id: INT, segmentation: ARRAY<ARRAY<DOUBLE>>, bbox: ARRAY<DOUBLE>>>"
)
