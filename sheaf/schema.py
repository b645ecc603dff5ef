"""Row types and fixed values."""

from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())

TASK = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("headers", STRINGS),
        T.StructField("params", STRINGS),
        T.StructField("body", T.StringType()),
    ]
)

# The columns of a topic log, the same as those of Spark's Kafka source.
LOG = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

OBJECT = T.StructType(
    [
        T.StructField("object_key", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

# A parsed page: its visible text once, and its nodes in document order. A node's id is its
# place in the array, ``last_id`` its last descendant, and its text a slice of the text.
NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("last_id", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", STRINGS),
        T.StructField("text_from", T.IntegerType()),
        T.StructField("text_to", T.IntegerType()),
    ]
)
TREE = T.StructType(
    [T.StructField("text", T.BinaryType()), T.StructField("nodes", T.ArrayType(NODE))]
)

# Names, limits and texts that results must agree on.
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]
QUERY_METHODS = ["GET", "OPTIONS", "HEAD"]
BODY_METHODS = ["POST", "PUT", "DELETE", "PATCH"]
TOPICS = {
    "API": "scrape.input.api",
    "HTML": "scrape.input.browser.html",
    "WEBDRIVER": "scrape.input.browser.webdriver",
}
PROFILES = {
    "scrape-all": ["API", "HTML", "WEBDRIVER"],
    "scrape-webdriver": ["WEBDRIVER"],
    "scrape-non-webdriver": ["API", "HTML"],
    "scrape-api": ["API"],
    "scrape-html": ["HTML"],
}
TASK_FIELD_NUMBERS = {"job_id": 1, "url": 2, "method": 3, "headers": 4, "params": 5, "body": 6}
REASONS = {
    "object": "object expected",
    "jobId": "jobId: string expected",
    "url": "url: string expected",
    "method": "method: string expected",
    "headers": "headers: object expected",
    "headers_values": "headers: string{k:string} expected",
    "params": "params: object expected",
    "params_values": "params: string{k:string} expected",
    "body": "body: string expected",
}
NOT_READY = "Results not yet available"
MAX_ATTEMPTS = 3
RETRY_WAIT_SECONDS = 2
TIMEOUT_SECONDS = 10
PREVIEW_BYTES = 500
RECLAIM_COUNT = 10
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
]
