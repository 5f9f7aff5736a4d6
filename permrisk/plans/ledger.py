"""Hash-chained predictions: build, verify, grade, account for and export."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.plans.dialect import Oracle
from permrisk.plans.graph import query, statement
from permrisk.sources.scratch import fresh

GENESIS = "0" * 64
BATCH_ENTRIES = 1 << 16


def _payloads(d):
    """Canonical JSON of the published predictions, in issue order."""
    return f"""
    SELECT application_id AS seq, filed_on AS published_on, outcome, decided_on, p1000,
           '{{"application":' || CAST(application_id AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) || ',"probability_per_mille":' || CAST(p1000 AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) || ',"use":"' || use_class || '"}}' AS payload
    FROM (SELECT *, (application_id * 37 + 11) % 1001 AS p1000 FROM application) a"""


def _linked(batches, prev: str):
    """Entry hashes of rows in order, from the hash before the first of them."""
    for batch in batches:
        before, after = [], []
        for payload_hash in batch.column("payload_hash").to_pylist():
            before.append(prev)
            prev = hashlib.sha256((prev + payload_hash).encode()).hexdigest()
            after.append(prev)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "prev_hash", "entry_hash"])


def chain(entries: DataFrame, seq: str = "seq", payload: str = "payload", genesis: str = GENESIS, *, batch: int = BATCH_ENTRIES) -> DataFrame:
    """Append entries to a chain: each hash covers the one before, so this is one ordered fold.

    The entries are cut by number into batches of about ``batch``; one task at a time sorts
    a batch and streams it from the last hash of the batch before, so no task or driver holds more.
    Checking (:func:`verified`) is local to neighbouring rows and parallel.
    """
    spark = entries.sparkSession
    hashed = entries.select(F.col(seq).cast("bigint").alias(seq), F.col(payload).alias("payload"), F.sha2(payload, 256).alias("payload_hash"))
    schema = f"`{seq}` bigint, payload string, payload_hash string, prev_hash string, entry_hash string"
    n = -(-hashed.count() // batch)
    if not n:
        return spark.createDataFrame([], schema)
    cuts = sorted(set(hashed.agg(F.percentile_approx(seq, [k / n for k in range(1, n)])).first()[0])) if n > 1 else []
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(seq))) if cuts else F.lit(0)
    cut, path = fresh(spark, "ledger-batches"), fresh(spark, "ledger")
    hashed.withColumn("batch", number).write.partitionBy("batch").parquet(cut)
    stored = spark.read.schema(f"`{seq}` bigint, payload string, payload_hash string, batch int").parquet(cut)
    prev = genesis
    for k in range(len(cuts) + 1):
        part = stored.where(F.col("batch") == k).drop("batch").coalesce(1).sortWithinPartitions(seq, "payload")
        part.mapInArrow(lambda b, prev=prev: _linked(b, prev), schema).write.parquet(f"{path}/{k:09d}")
        last = spark.read.schema(schema).parquet(f"{path}/{k:09d}").agg(F.max_by("entry_hash", F.struct(seq, "payload"))).first()[0]
        prev = last or prev
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def verified(ledger: DataFrame, issued: int | None = None, first: int = 0, seq: str = "seq") -> DataFrame:
    """First break and completeness: payload against its hash, link to the row before, entry against both.

    Numbers are issued without gaps, so the row before is an equi-join on the number and nothing is sorted in one task.
    """
    before = ledger.select((F.col(seq) + 1).alias(seq), F.col("entry_hash").alias("before"))
    link = F.when(F.col(seq) == first, F.lit(GENESIS)).otherwise(F.col("before"))
    checks = ledger.join(before, seq, "left").select(
        seq, (F.sha2("payload", 256) == F.col("payload_hash")).alias("payload_ok"), F.coalesce(F.col("prev_hash") == link, F.lit(False)).alias("link_ok"),
        (F.sha2(F.concat("prev_hash", "payload_hash"), 256) == F.col("entry_hash")).alias("entry_ok"),
    )
    broken = ~(F.col("payload_ok") & F.col("link_ok") & F.col("entry_ok"))
    last = F.max(seq)
    number = last if issued is None else F.lit(issued).cast("bigint")
    return checks.agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(broken, F.col(seq))).alias("first_break"), F.count_if(broken).alias("broken"), number.alias("issued"), (last == number).alias("complete"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = query(_payloads)[0](spark, sf_dir).select(F.col("seq").cast("bigint").alias("seq"), "payload")
    return chain(entries)


CHAIN_SQL = f"""
    entry AS (SELECT seq, payload, sha256(payload) AS payload_hash, row_number() OVER (ORDER BY seq) AS rn FROM issued),
    chained AS (
        SELECT rn, seq, payload, payload_hash, '{GENESIS}' AS prev_hash, sha256('{GENESIS}' || payload_hash) AS entry_hash FROM entry WHERE rn = 1
        UNION ALL SELECT e.rn, e.seq, e.payload, e.payload_hash, c.entry_hash, sha256(c.entry_hash || e.payload_hash) FROM chained c JOIN entry e ON e.rn = c.rn + 1)"""


def _oracle(tail: str) -> str:
    sql = statement(f"WITH issued AS ({_payloads(Oracle).strip()}), {CHAIN_SQL.strip()} {tail}", Oracle)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select("seq", "payload_hash", "prev_hash", "entry_hash")


def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(_ledger(spark, sf_dir))


def ledger_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload edited and the last entry dropped: the first shows as a break, the second against the number issued."""
    ledger = _ledger(spark, sf_dir)
    issued = ledger.agg(F.max("seq")).first()[0]
    edited = ledger.where(F.col("seq") < issued).withColumn("payload", F.when(F.col("seq") == 500, F.lit("{}")).otherwise(F.col("payload")))
    return verified(edited, issued)


def grades(d):
    """Each resolved prediction: squared error, direction, whether its interval admits the outcome, and misses."""
    return f"""
    WITH issued AS ({_payloads(d).strip()}),
    resolved AS (SELECT *, p1000 / 1000.0 AS p, CASE WHEN outcome IN ('approved', 'approved_with_conditions') THEN 1.0 ELSE 0.0 END AS y FROM issued WHERE outcome NOT IN ('pending', 'withdrawn'))
    SELECT seq, outcome, round((p - y) * (p - y), 6) AS brier, (p >= 0.5) = (y = 1.0) AS right_direction, CASE WHEN y = 1.0 THEN p + 0.2 >= 0.5 ELSE p - 0.2 <= 0.5 END AS interval_admits,
           abs(p - y) > 0.65 AS miss, round({d.days('decided_on', 'published_on')} / 30.44, 6) AS months FROM resolved"""


def public_record(d):
    return f"""
    WITH issued AS ({_payloads(d).strip()}),
    marked AS (SELECT *, outcome IN ('approved', 'approved_with_conditions') AS ok, outcome NOT IN ('pending', 'withdrawn') AS done, p1000 / 1000.0 AS p FROM issued)
    SELECT count(*) AS published, count(*) FILTER (WHERE done) AS resolved, count(*) FILTER (WHERE NOT done) AS open, count(*) FILTER (WHERE done AND abs(p - CASE WHEN ok THEN 1.0 ELSE 0.0 END) > 0.65) AS misses,
           round(avg((p - CASE WHEN ok THEN 1.0 ELSE 0.0 END) * (p - CASE WHEN ok THEN 1.0 ELSE 0.0 END)) FILTER (WHERE done), 6) AS brier, min(CASE WHEN NOT done THEN published_on END) AS oldest_open,
           max(published_on) AS latest FROM marked"""


def daily_digest(d):
    """One digest of the payloads of each year in sequence, which shows any edit, loss or change of order."""
    return f"""
    WITH issued AS ({_payloads(d).strip()})
    SELECT CAST(extract(year FROM published_on) AS INT) AS year, count(*) AS n, max(seq) AS last_seq, md5({d.joined('md5(payload)', 'seq')}) AS digest FROM issued GROUP BY 1"""


def export_slice(d):
    """Entries behind a sequence number, a page at a time."""
    return f"""
    WITH issued AS ({_payloads(d).strip()}), placed AS (SELECT seq, payload, row_number() OVER (ORDER BY seq) AS rn FROM issued WHERE seq > 250)
    SELECT seq, payload FROM placed WHERE rn <= 100"""


def resolvable(d):
    """Predictions whose application has been decided since they were published."""
    return f"""
    WITH issued AS ({_payloads(d).strip()})
    SELECT i.seq, a.outcome, a.decided_on FROM issued i JOIN application a ON a.application_id = i.seq WHERE a.decided_on > i.published_on AND a.outcome NOT IN ('pending', 'withdrawn')"""


QUERIES = {
    "ledger_chain": (ledger_chain, _oracle("SELECT seq, payload_hash, prev_hash, entry_hash FROM chained")),
    "ledger_verify": (ledger_verify, _oracle("SELECT count(*) AS entries, CAST(NULL AS BIGINT) AS first_break, CAST(0 AS BIGINT) AS broken, max(seq) AS issued, true AS complete FROM chained")),
    "ledger_tampered": (ledger_tampered, _oracle("SELECT count(*) - 1 AS entries, CAST(500 AS BIGINT) AS first_break, CAST(1 AS BIGINT) AS broken, max(seq) AS issued, false AS complete FROM chained")),
} | {f"ledger_{f.__name__}": query(f) for f in (grades, public_record, daily_digest, export_slice, resolvable)}
