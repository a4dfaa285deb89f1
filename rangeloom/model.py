"""Schemas and fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TENSORS = (
    "file_id int, path string, tensor_index int, name string, dtype string, shape array<bigint>, storage_shape array<bigint>, "
    "item_count bigint, data_start bigint, data_end bigint, file_offset bigint, nbytes bigint"
)
RANGES = "file_id int, path string, range_index int, offset bigint, size bigint"
RESPONSES = "submission_id bigint, file_index int, range_index int, code int, arrival timestamp"

# Bytes of an element, and logical values in one element.
DTYPES = {
    "F64": (8, 1),
    "F32": (4, 1),
    "F16": (2, 1),
    "BF16": (2, 1),
    "F8_E4M3": (1, 1),
    "F8_E5M2": (1, 1),
    "F8_E8M0": (1, 1),
    "F4": (1, 2),
    "I64": (8, 1),
    "I32": (4, 1),
    "I16": (2, 1),
    "I8": (1, 1),
    "U64": (8, 1),
    "U32": (4, 1),
    "U16": (2, 1),
    "U8": (1, 1),
    "BOOL": (1, 1),
    "C64": (8, 1),
}

# Messages of the response codes 0 to 28; where one would name a product, it says "streamer" instead.
MESSAGES = (
    "Request sent successfuly",
    "Finished all responses",
    "File access error",
    "End of file reached",
    "S3 not supported",
    "GLIBC version should be at least 2.28",
    "Increase process fd limit or decrease the concurrency level. Recommended value for the streamer alone is the concurrency multiplied by 64, in addition to your application fd usage",
    "Invalid request parameters",
    "Empty request parameters",
    "Streamer is handling previous request",
    "CA bundle file not found",
    "Unknown Error",
    "Error loading object storage plugin",
    "GCS not supported",
    "Azure Blob not supported",
    "Object storage returned an unexpected number of bytes for the requested range (truncated or over-length response)",
    "Timed out waiting for a response",
    "Streamer is locked to a single object-storage backend (S3/GCS/Azure); mixing object-storage backends in one streamer or submission is not supported",
    "Credentials were already set to a different value; create a new streamer to use different credentials",
    "Retryable object storage file access error",
    "The filesystem read strategy was already set to a different value; set it once before the first request",
    "None of the filesystem read strategies in the list can be served on this host; add sync_buffered to the list to allow the synchronous reader",
    "The asynchronous filesystem reader for this mount failed and will not be used again; the storage itself is healthy, and re-requesting these ranges reads them through the synchronous reader",
    "The requested device type is not supported by this build of the streamer; only the CPU can be read into",
    "No usable device is present: the device driver could not be loaded, or it reports no devices",
    "There is no device with the requested ordinal",
    "An allocation on the device path was refused - device memory, or host memory to be pinned; ask for less, or release what is already held",
    "The transfer to the device failed; these ranges were not written and the destination is unchanged",
    "The device driver failed; the driver and the installed libraries do not agree, or the context is gone",
)
INVALID_CODE = "Invalid response code"
SUCCESS, FINISHED, FILE_ACCESS, END_OF_FILE, MIXED_BACKENDS, CREDENTIALS_SET, RETRYABLE = 0, 1, 2, 3, 17, 18, 19

# Names of read strategies.
STRATEGIES = ("io_uring_direct", "io_uring_buffered", "libaio_direct", "sync_buffered")


def dtype_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DTYPES.items()], "dtype string, element_bytes int, values_per_element int")
