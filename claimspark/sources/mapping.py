"""Claims tables derived from the driver's TPC-H-like tables.

The driver ships ``customer supplier part orders lineitem nation region``;
this module re-expresses them as the claims data model so every operator
runs on real, scale-growing data:

* patients       <- customer x nation
* providers      <- supplier x nation x region
* claims         <- lineitem x orders x part (one claim per line item)
* investigations <- fraud claims whose order key is not a multiple of 4

Everything is lazy; Catalyst prunes the columns each query needs and pushes
filters into the parquet scans.  ``nation`` and ``region`` have a fixed size
(25 and 5 rows at every scale factor), so they are the only sides broadcast by
hint; all other joins are left to AQE, which broadcasts a side only after
measuring it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.schemas import MONEY
from claimspark.session import delete_dir, free_shuffles, shared_dir

# FIXED VALUES — the mapping rules (shared with the SQL oracle)
POLICY_START = "2020-01-01"
GENDERS = ["Male", "Female"]                 # by c_custkey % 2
PREMIUM_TIERS = ["Basic", "Standard", "Premium"]  # by c_custkey % 3
FRAUD_RETURN_FLAG = "R"                      # is_fraud: returned line ...
FRAUD_MAX_LINENUMBER = 2                     # ... with line number <= 2
FRAUD_AMOUNT_MULTIPLIER = 3                  # fraud claims bill 3x the line price
PROCEDURE_MODULUS = 15                       # num_procedures = 1 + qty % 15
# claim_id = 'CLM' + orderkey(12) '-' linenumber(2) '-' partkey(11) '-' suppkey(10) '-' yyyyMMdd
ID_WIDTHS = (12, 2, 11, 10)


# Kept per application; ``forget`` drops them when input files have changed.
_RAW: dict[tuple, DataFrame] = {}
_TABLES: dict[tuple, dict[str, DataFrame]] = {}
_PATHS: dict[tuple, str] = {}


def _session_key(spark: SparkSession) -> tuple:
    return (spark.sparkContext.applicationId,)


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Read and map the tables of ``sf_dir`` (default: of all folders) anew next
    time, and delete the written copies."""
    app, folder = spark.sparkContext.applicationId, None if sf_dir is None else sf_dir.rstrip("/")
    for kept in (_RAW, _TABLES, _PATHS):
        for key in [k for k in kept if k[0] == app and folder in (None, k[1])]:
            value = kept.pop(key)
            if kept is _PATHS:
                delete_dir(spark, value.rsplit("/", 1)[0])


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the DataFrame (file listing + footer schema) is reused
    for the lifetime of the session."""
    key = _session_key(spark) + (sf_dir.rstrip("/"), name)
    if key not in _RAW:
        _RAW[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _RAW[key]


def _pad(c: str, width: int):
    """Zero-padded to ``width``; longer keys keep all their digits."""
    text = F.col(c).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_raw(spark, sf_dir, "customer")
    n = read_raw(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "inner")
            .select(
                key.alias("patient_id"),
                F.col("c_name").alias("name"),
                (F.lit(18) + key % 63).cast("int").alias("age"),
                F.when(key % 2 == 0, F.lit(GENDERS[0])).otherwise(F.lit(GENDERS[1])).alias("gender"),
                F.col("n_name").alias("city"),
                F.col("c_mktsegment").alias("policy_type"),
                F.when(key % 3 == 0, F.lit(PREMIUM_TIERS[0]))
                 .when(key % 3 == 1, F.lit(PREMIUM_TIERS[1]))
                 .otherwise(F.lit(PREMIUM_TIERS[2])).alias("premium_tier"),
                F.lit(POLICY_START).cast("date").alias("policy_start"),
                F.when(key % 4 == 0, F.lit("No")).otherwise(F.lit("Yes")).alias("kyc_verified"),
            ))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_raw(spark, sf_dir, "supplier")
    n = read_raw(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_raw(spark, sf_dir, "region").select("r_regionkey", "r_name")
    key = F.col("s_suppkey")
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "inner")
            .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "inner")
            .select(
                key.alias("provider_id"),
                F.col("s_name").alias("hospital_name"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("provider_type"),
                F.when(key % 4 == 0, F.lit("No")).otherwise(F.lit("Yes")).alias("empanelled"),
            ))


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what the claims need of their orders and parts.  A line item
    without its order or part stays, so that ``dq_orphans`` can report it."""
    li = read_raw(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    o = read_raw(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    p = read_raw(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "left")
            .join(p, li.l_partkey == p.p_partkey, "left").drop("o_orderkey", "p_partkey"))


def _claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims plus the two order attributes the investigations need."""
    return _claims_of(_line_items(spark, sf_dir))


def _claims_of(items: DataFrame) -> DataFrame:
    fraud = (F.col("l_returnflag") == FRAUD_RETURN_FLAG) & (F.col("l_linenumber") <= FRAUD_MAX_LINENUMBER)
    qty = F.floor(F.col("l_quantity")).cast("bigint")
    w_o, w_l, w_p, w_s = ID_WIDTHS
    claim_id = F.concat(
        F.lit("CLM"), _pad("l_orderkey", w_o), F.lit("-"), _pad("l_linenumber", w_l), F.lit("-"),
        _pad("l_partkey", w_p), F.lit("-"), _pad("l_suppkey", w_s), F.lit("-"),
        F.date_format("l_shipdate", "yyyyMMdd"))
    dup = fraud & (qty % 3 > 0)
    return (items
            .select(
                claim_id.alias("claim_id"),
                F.col("o_custkey").alias("patient_id"),
                F.col("l_suppkey").alias("provider_id"),
                F.col("p_type").alias("disease_category"),
                (F.col("l_extendedprice").cast(MONEY)
                 * F.when(fraud, F.lit(FRAUD_AMOUNT_MULTIPLIER)).otherwise(F.lit(1))).cast(MONEY)
                .alias("claim_amount"),
                F.col("l_linenumber").cast("int").alias("days_hospitalised"),
                (F.lit(1) + qty % PROCEDURE_MODULUS).cast("int").alias("num_procedures"),
                F.to_date("l_shipdate").alias("claim_date"),
                dup.cast("int").alias("duplicate_claim"),
                (~dup).cast("int").alias("empanelled_provider"),
                F.col("o_orderstatus").alias("claim_status"),
                fraud.cast("int").alias("is_fraud"),
                F.col("l_orderkey").alias("_orderkey"),
                F.col("o_orderpriority").alias("_orderpriority"),
            ))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claim_rows(spark, sf_dir).drop("_orderkey", "_orderpriority")


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _investigations_from(_claim_rows(spark, sf_dir))


def _investigations_from(rows: DataFrame) -> DataFrame:
    return (rows.filter((F.col("is_fraud") == 1) & (F.col("_orderkey") % 4 > 0))
            .select(
                F.concat(F.lit("INV"), F.col("claim_id")).alias("investigation_id"),
                "claim_id", "patient_id",
                F.col("_orderpriority").alias("fraud_type"),
                F.col("claim_date").alias("investigation_date"),
                F.col("claim_status").alias("status"),
                F.col("claim_amount").alias("amount_recovered"),
            ))


def load_tables(spark: SparkSession, sf_dir: str, materialize: bool = False) -> dict[str, DataFrame]:
    """The four claims tables for a testdata folder.

    Lazy by default.  With ``materialize`` the mapped tables are written once
    per session as Parquet under the shared checkpoint folder (the ingest step
    of a real deployment, where claims are a stored table) and read back, so
    queries scan a claims table instead of re-joining line items and orders.
    """
    key = _session_key(spark) + (sf_dir.rstrip("/"), materialize)
    if key in _TABLES:
        return _TABLES[key]
    if not materialize:
        rows = _claim_rows(spark, sf_dir)
        tables = {"patients": patients(spark, sf_dir), "providers": providers(spark, sf_dir),
                  "claims": rows.drop("_orderkey", "_orderpriority"),
                  "investigations": _investigations_from(rows)}
    else:
        base = shared_dir(spark, "claims-tables")
        # Clustered by patient, the key of the pair and total queries, into enough
        # files for every core to get a split when the table is scanned (the
        # shuffle-partition setting is sized to the data on a cluster).  Ranges of
        # (patient, line item) are of equal size even if one patient, or a missing one,
        # holds most claims.  Line items are dealt out, which are half as wide as
        # the claims made of them.  What the joins and the ranges shuffled goes at once.
        files = max(2 * spark.sparkContext.defaultParallelism,
                    int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
        patients(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/patients")
        providers(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/providers")
        dealt = _line_items(spark, sf_dir).repartitionByRange(files, "o_custkey", "l_orderkey", "l_linenumber")
        (_claims_of(dealt)
         .write.mode("overwrite").parquet(f"{base}/claim_rows"))
        del dealt
        free_shuffles(spark)
        rows = spark.read.parquet(f"{base}/claim_rows")
        _PATHS[key] = f"{base}/claim_rows"
        tables = {"patients": spark.read.parquet(f"{base}/patients"),
                  "providers": spark.read.parquet(f"{base}/providers"),
                  "claims": rows.drop("_orderkey", "_orderpriority"),
                  "investigations": _investigations_from(rows)}
    _TABLES[key] = tables
    return tables


def materialized_claims_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the written claim rows (``load_tables(..., materialize=True)``),
    e.g. to replay them as a stream; the claims columns are a projection of it."""
    load_tables(spark, sf_dir, materialize=True)
    return _PATHS[_session_key(spark) + (sf_dir.rstrip("/"), True)]
