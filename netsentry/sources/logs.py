"""Log events from CSV, JSON messages and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsentry.functions.text import timestamp_or_null
from netsentry.schema import LOG_COLUMNS, LOG_SCHEMA

REPLAY_FIRST = 2000  # fixed value: rows sent first
REPLAY_NEXT = 500  # fixed value: default size of the following slices


def read_log_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Log events of CSV files with a header, in the fields of `LOG_SCHEMA`.

    Columns are found by their name in the header, in any order; missing ones are null, others are left out, and a value
    that does not fit its type is null. Quoted text may hold commas and doubled quotes. With `multi_line` it may also
    hold line breaks; a file is then read by one task. All files of a path must have the same header, else reading fails.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "enforceSchema": False}
    raw = spark.read.options(**options).csv(path)
    named = {c.lower(): c for c in raw.columns}
    return raw.select(
        *[
            (F.col(f"`{named[f.name]}`").try_cast(f.dataType) if f.name in named else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in LOG_SCHEMA.fields
        ]
    )


def encode_json(logs: DataFrame, position: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keyed messages: `key` is the source IP, `value` the JSON of the ten fields, all text but the bytes.

    With `position` they carry, beside the value, the sender's number of the message, which stays the same when a message
    is sent again.
    """
    fields = [
        F.col(name).cast("int" if isinstance(LOG_SCHEMA[name].dataType, T.IntegerType) else "string").alias(name)
        for name in LOG_COLUMNS
    ]
    return logs.select(
        F.col("source_ip").cast("string").alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
        *([F.col(position).cast("bigint").alias("position")] if position else []),
        *keep,
    )


def parse_json(raw: DataFrame, schema: T.StructType = LOG_SCHEMA, value: str = "value", keep: tuple = ()) -> DataFrame:
    """Flat fields of the JSON messages; a malformed message gives nulls. Works on batch and stream."""
    parsed = raw.select(*keep, F.from_json(F.col(value).cast("string"), schema).alias("data"))
    return parsed.select(*keep, "data.*")


def rejects(raw: DataFrame, value: str = "value") -> DataFrame:
    """One row: `messages`, and `rejected`, those that `parse_json` reads as nulls only. Works on batch and stream."""
    parsed = raw.select(F.from_json(F.col(value).cast("string"), LOG_SCHEMA).alias("data"))
    empty = F.coalesce(*[F.col(f"data.{name}").cast("string") for name in LOG_COLUMNS]).isNull()
    return parsed.agg(F.count("*").alias("messages"), F.count_if(empty).alias("rejected"))


# Why a message is in quarantine, in the order of the tests.
EMPTY, MALFORMED, MISTYPED, FOREIGN = "no value", "not a JSON object", "a field of another type", "no known field"


def rejected(raw: DataFrame, value: str = "value", keep: tuple = ()) -> DataFrame:
    """The messages that cannot be read in full, as they came: `keep`, `value` and the `reason`. Works on batch and stream.

    A message with a field of another type is read by `parse_json`, too, with null in that field; of the others it reads
    nulls only.
    """
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("_unread", T.StringType())])
    text = F.col(value).cast("string")
    read = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    rows = raw.select(*keep, text.alias(value), read.alias("data"))
    nothing = F.coalesce(*[F.col(f"data.{name}").cast("string") for name in LOG_COLUMNS]).isNull()
    blank = F.col(value).isNull() | F.col(value).rlike(r"^\s*$")
    # The reader reports a wrong type and a wrong syntax alike; what is an object has its text parsed without a schema.
    is_object = F.try_parse_json(F.col(value)).isNotNull() & F.col(value).rlike(r"^\s*\{")
    reason = (
        F.when(blank, EMPTY)
        .when(F.col("data._unread").isNotNull(), F.when(is_object, MISTYPED).otherwise(MALFORMED))
        .when(nothing, F.when(is_object, FOREIGN).otherwise(MALFORMED))
    )
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*keep, value, "reason")


def with_event_time(logs: DataFrame) -> DataFrame:
    """Adds `event_time`: its own value where present and readable, else the parsed `timestamp` text."""
    candidates: list[Column] = []
    if "event_time" in logs.columns:
        own = F.col("event_time")
        if not isinstance(logs.schema["event_time"].dataType, T.TimestampType):
            own = timestamp_or_null(own.cast("string"))
        candidates.append(own)
    if "timestamp" in logs.columns:
        candidates.append(timestamp_or_null(F.col("timestamp").cast("string")))
    return logs.withColumn("event_time", F.coalesce(*candidates))


def with_archived_at(logs: DataFrame, default: Column | None = None) -> DataFrame:
    """Keeps `archived_at` as a timestamp; where the column is missing altogether it becomes `default` or now."""
    if "archived_at" not in logs.columns:
        return logs.withColumn("archived_at", F.current_timestamp() if default is None else default)
    if isinstance(logs.schema["archived_at"].dataType, T.TimestampType):
        return logs
    return logs.withColumn("archived_at", timestamp_or_null(F.col("archived_at").cast("string")))


def normalize(logs: DataFrame) -> DataFrame:
    """Text columns as strings, action and label in lower case, bytes as long. The detectors expect this form."""
    return logs.withColumns(
        {
            "source_ip": F.col("source_ip").cast("string"),
            "dest_ip": F.col("dest_ip").cast("string"),
            "protocol": F.col("protocol").cast("string"),
            "action": F.lower("action"),
            "threat_label": F.lower("threat_label"),
            "user_agent": F.col("user_agent").cast("string"),
            "request_path": F.col("request_path").cast("string"),
            "bytes_transferred": F.col("bytes_transferred").cast("long"),
        }
    )


def prepare(logs: DataFrame) -> DataFrame:
    """Event time and archive time filled in, then normalized: the input of the batch detectors."""
    return normalize(with_archived_at(with_event_time(logs)))


def with_date_parts(logs: DataFrame, time_col: str = "event_time") -> DataFrame:
    """Adds the archive's partition columns."""
    return logs.withColumns(
        {
            "year": F.year(time_col),
            "month": F.month(time_col),
            "day": F.dayofmonth(time_col),
            "hour": F.hour(time_col),
        }
    )


def replay_slice(logs: DataFrame, order_by: str, offset: int = 0, rows: int = REPLAY_FIRST) -> DataFrame:
    """Consecutive rows of a replay: `rows` of them from `offset`. A slice that runs past the end is simply shorter."""
    if offset < 0 or rows < 1:
        raise ValueError("a slice begins at 0 or later and has at least one row")
    return logs.orderBy(order_by).offset(offset).limit(rows)


NARROW_BINS = 1_024  # ranges of the order column that are counted at a time
NARROW_ROWS = 100_000  # rows beyond the slice itself that may be sorted to find it


def _number(column: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("bigint")
    raise TypeError(f"{column} must be a whole number, a date or a timestamp")


def deep_slice(logs: DataFrame, order_by: str, offset: int, rows: int, bins: int = NARROW_BINS, most: int = NARROW_ROWS) -> DataFrame:
    """`replay_slice` for offsets far into a large table; `order_by` is a whole number, a date or a timestamp, nulls first.

    The column's range is cut into `bins`, their rows are counted, and running sums tell which bins hold the slice; those
    are cut again until they hold few rows more than the slice. Only rows of that range are sorted: the comparison that
    keeps them reaches the reader, so other row groups are not even read. Give a stored table; each round reads the
    column of the range left. Rows with equal values cannot be told apart and are sorted together.
    """
    if offset < 0 or rows < 1:
        raise ValueError("a slice begins at 0 or later and has at least one row")
    kind = logs.schema[order_by].dataType
    number = _number(order_by, kind)
    left = logs.filter(F.col(order_by).isNotNull())
    bounds = logs.agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n"), F.count(order_by).alias("known")).first()
    if offset < bounds["n"] - bounds["known"] or bounds["low"] is None:
        return logs.orderBy(order_by).offset(offset).limit(rows)
    low, high, inside, skipped = bounds["low"], bounds["high"], bounds["known"], offset - (bounds["n"] - bounds["known"])
    while inside > rows + most and low < high:
        width = (high - low) // bins + 1
        bin_of = F.expr(f"(_at - ({low})) div {width}").alias("bin")
        counts = dict(left.select(number.alias("_at")).groupBy(bin_of).count().collect())  # `bins` rows at most
        before, chosen, start = 0, [], 0
        for place in sorted(counts):
            if before + counts[place] > skipped and before < skipped + rows:
                start = start if chosen else before
                chosen.append(place)
            before += counts[place]
        if not chosen:  # past the end
            return left.limit(0)
        reached = low + chosen[0] * width, min(high, low + (chosen[-1] + 1) * width - 1)
        inside, skipped = sum(counts[place] for place in chosen), skipped - start
        if reached == (low, high):  # no bin can be left out
            break
        low, high = reached
        left = left.filter((F.col(order_by) >= _value(low, kind)) & (F.col(order_by) <= _value(high, kind)))
    return left.orderBy(order_by).offset(skipped).limit(rows)


def _value(number: int, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(number))
    return F.date_from_unix_date(F.lit(number).cast("int")) if isinstance(kind, T.DateType) else F.lit(number)


def publish_kafka(logs: DataFrame, servers: str, topic: str) -> None:
    """Sends the messages from the executors; needs the Kafka connector on the class path."""
    (
        encode_json(logs)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def stream_kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_offsets: int | None = None,
    starting: str = "latest",
) -> DataFrame:
    """Keyed message stream, `key` and `value` as text; needs the Kafka connector on the class path.

    `max_offsets` bounds the messages of a micro-batch; by default a batch takes what has arrived.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None, position: bool = False) -> DataFrame:
    """The same stream from a folder of JSON-line files with `key` and `value`, and with `position` where the sender
    numbers its messages; where there is no broker. `max_files` bounds the files of a micro-batch."""
    reader = spark.readStream.schema("key string, value string" + (", position bigint" if position else ""))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def deliver(messages: DataFrame, batch: str, batches: range, path: str, files: int = 1) -> None:
    """Appends the messages to a folder of JSON-line files, one batch after the other: those with the first number in the
    column `batch`, then the next. A stream of the folder that takes `files` files at a time sees each batch as one
    micro-batch."""
    for number in batches:
        messages.filter(F.col(batch) == number).drop(batch).repartition(files).write.mode("append").json(path)
