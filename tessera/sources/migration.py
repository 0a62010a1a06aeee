"""Reading legacy tables and writing targets: partitioned JDBC scans, samples, checkpoints, COPY text, quarantine and receipts."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How each dialect is asked whether it only reads, and the answers that say so.
READ_ONLY = {
    "postgres": ("SHOW transaction_read_only", lambda v: str(v).lower() in ("on", "true", "1")),
    "mysql": ("SELECT @@read_only", lambda v: bool(v) and str(v) not in ("0", "OFF", "off")),
    "oracle": ("SELECT OPEN_MODE FROM V$DATABASE", lambda v: "READ ONLY" in str(v).upper()),
}
#: Words by which an error tells that another attempt will not help.
LASTING = ("syntax", "does not exist", "not found", "password", "authentication", "permission", "access denied", "not authorized", "unknown column")
#: Rows fetched at once, and attempts at a connection.
FETCH, ATTEMPTS = 5000, 3


class ReadOnlyError(RuntimeError):
    pass


def with_retry(action: Callable, attempts: int = ATTEMPTS, wait: Callable[[int], float] = lambda n: min(2**n, 5), sleep: Callable[[float], None] = time.sleep):
    """The result of an action that may fail to connect: tried again after 1, 2, 4 and then 5 seconds, unless the error says that it will
    last, such as wrong SQL or a refused password.  Tasks of a scan are Spark's to retry."""
    for n in range(attempts):
        try:
            return action()
        except Exception as e:
            if n + 1 == attempts or any(w in str(e).lower() for w in LASTING):
                raise
            sleep(wait(n))
    raise ValueError("no attempts")


def check_read_only(dialect: str, ask: Callable[[str], object]) -> None:
    """Raises unless the connection that ``ask`` queries says that it only reads; a failing query counts as no."""
    if dialect not in READ_ONLY:
        raise ReadOnlyError(f"no read-only check for {dialect}")
    question, yes = READ_ONLY[dialect]
    try:
        answer = ask(question)
    except Exception as e:
        raise ReadOnlyError(f"{dialect}: {e}") from e
    if not yes(answer):
        raise ReadOnlyError(f"{dialect} connection is not read-only ({answer!r})")


def jdbc_scan(spark: SparkSession, url: str, table: str, columns: list[str], *, key: str | None = None, partitions: int = 8, fetch: int = FETCH, options: dict[str, str] | None = None, dialect: str | None = None) -> DataFrame:
    """The columns of a table, read in ``partitions`` ranges of a numeric key.  Filters and further projections reach the database.

    With a ``dialect``, the connection must say that it only reads.
    """

    def reader():
        return spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), **(options or {}))

    def ask(question: str):
        return reader().option("query", question).load().first()[0]

    if dialect:
        check_read_only(dialect, lambda q: with_retry(lambda: ask(q)))
    source = reader().option("dbtable", table)
    if key:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        low, high = with_retry(lambda: reader().option("query", f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}").load().first())
        if low is not None:
            source = source.options(partitionColumn=key, lowerBound=str(low), upperBound=str(int(high) + 1), numPartitions=str(partitions))
    return source.load().select(*columns)


def documents_scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Collections exported as JSON lines: the columns (null where a document lacks one) and ``_id``, as text."""
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    return raw.select(*[F.try_variant_get("v", f"$['{c}']", "string").alias(c) for c in dict.fromkeys(["_id", *columns])])


def distinct_sample(df: DataFrame, column: str, n: int = 100, seed: str = "0") -> DataFrame:
    """Up to ``n`` distinct values as text, chosen by a hash of seed and value: the same ones on every run."""
    v = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return v.orderBy(F.md5(F.concat(F.lit(seed), "value"))).limit(n)


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under their target names; those that are not mapped keep theirs."""
    return df.select(*[F.col(c).alias(mapping.get(c, c)) for c in df.columns])


def reconcile(mappings: DataFrame, specs: DataFrame, halts: DataFrame) -> DataFrame:
    """(key, problem) for each mapped column: two specs, both a spec and a halt, or neither of them."""
    n = specs.groupBy("key").agg(F.count(F.lit(1)).alias("n_specs"))
    h = halts.select("key", F.lit(True).alias("halted")).distinct()
    all_ = mappings.select("key").distinct().join(n, "key", "full_outer").join(h, "key", "full_outer")
    n_specs, halted = F.coalesce("n_specs", F.lit(0)), F.coalesce("halted", F.lit(False))
    problem = F.when(n_specs > 1, "duplicate_spec").when((n_specs > 0) & halted, "spec_and_halt").when((n_specs == 0) & ~halted, "unmapped")
    return all_.select("key", problem.alias("problem")).where("problem is not null")


def copy_line(df: DataFrame, columns: list[str], nulls: str = "\\N") -> Column:
    """A row as COPY reads it: comma-separated, text quoted where it must be, ``t`` and ``f``, nulls marked."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(c: str) -> Column:
        if kinds[c] == "boolean":
            text = F.when(F.col(c), "t").otherwise("f")
        else:
            text = F.col(c).cast("string")
            quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
            text = F.when(text.rlike('[",\\r\\n]') | (text == nulls), quoted).otherwise(text)
        return F.when(F.col(c).isNull(), nulls).otherwise(text)

    return F.concat_ws(",", *map(one, columns))


def key_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def database_fingerprint(user: Column, host: Column, port: Column, database: Column) -> Column:
    """Tells which database was written without its password."""
    return F.sha2(F.concat(user, F.lit("@"), host, F.lit(":"), port.cast("string"), F.lit("/"), database), 256)


def quarantine_manifest(rejected: DataFrame, batch: str, keys: list[str], raw: list[str] | None = None) -> DataFrame:
    """(batch, n_rows, manifest) for each batch that has rejected rows (with ``reason``): key hashes and reasons as
    JSON, in the order of the hashes; values only if ``raw`` names their columns.  A batch is of bounded size."""
    entry = [key_hash(keys).alias("pk_hash"), F.col("reason")]
    if raw:
        entry.append(F.struct(*raw).alias("values"))
    g = rejected.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("entries"))
    return g.select(batch, F.size("entries").alias("n_rows"), F.to_json(F.struct(F.col(batch), "entries")).alias("manifest"))


def batch_receipts(batches: DataFrame, table: str, order: str, fields: list[str]) -> DataFrame:
    """(table, order, receipt, receipt_hash): canonical JSON (keys in order, no spaces) of each batch, and its digest."""
    names = sorted([table, order, *fields])
    out = batches.withColumn("receipt", F.to_json(F.struct(*names)))
    return out.select(table, order, "receipt", F.sha2("receipt", 256).alias("receipt_hash"))


def checkpoint_of(done: DataFrame, tables: str = "table_name", batch: str = "batch_no", last: str = "last_pk") -> DataFrame:
    """(table, last_batch_no_complete, last_pk_seen): the end of each table's gapless run of complete batches from 0."""
    from ..operators.ordered import positions

    rows = positions(done.dropDuplicates([tables, batch]), [tables], [batch], "_i").where(F.col("_i") == F.col(batch))
    return rows.groupBy(tables).agg(F.max(batch).alias("last_batch_no_complete"), F.max_by(last, batch).alias("last_pk_seen"))


def resumed(rows: DataFrame, checkpoint: DataFrame, tables: str = "table_name", batch: str = "batch_no") -> DataFrame:
    """Rows of the batches after the checkpoint of their table (a row for each table)."""
    at = checkpoint.select(F.col(tables).alias("_t"), F.col("last_batch_no_complete").alias("_b"))
    return rows.join(F.broadcast(at), F.col(tables) == F.col("_t"), "left").where(F.col("_b").isNull() | (F.col(batch) > F.col("_b"))).drop("_t", "_b")


def replaced(df: DataFrame, path: str) -> None:
    """Writes a table over what was there, or nothing at all: ``reset`` is this with no rows."""
    df.write.mode("overwrite").parquet(path)


def imported(existing: DataFrame, snapshot: DataFrame, dedupe: list[str] | None = None) -> DataFrame:
    """A snapshot appended as it is; with ``dedupe``, only rows whose key is new and does not repeat."""
    if not dedupe:
        return existing.unionByName(snapshot)
    from ..operators.graph import insert_absent

    return existing.unionByName(insert_absent(existing, snapshot, dedupe).select(*existing.columns))


def attempts(rows: DataFrame, key: str) -> DataFrame:
    """Rebuild attempts of each node in the order they were made."""
    return rows.orderBy(key, "attempt_number", "id")


def same_columns(frames: list[DataFrame]) -> list[str]:
    """The column list that all parts of a write share."""
    first = frames[0].columns
    for f in frames[1:]:
        if f.columns != first:
            raise ValueError(f"columns differ: {first} and {f.columns}")
    return first


def union_all(frames: list[DataFrame]) -> DataFrame:
    same_columns(frames)
    return reduce(lambda a, b: a.union(b), frames)
