"""

``entry(spark)`` runs the flagship query (claim inflation) on sf0.001;
``queries()`` maps every implemented operator to a callable
``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` gives the DuckDB SQL for
the same result (``oracle_queries.py``).  Every query reads the driver's
tables through ``claimspark.sources.mapping`` so its work grows with them.

The mapped tables are written once per session (``load_tables(...,
materialize=True)``) and every query scans them, as it would scan stored
claims tables in production.

For cross-engine comparison the registered results return money as DOUBLE
and dates as ``YYYY-MM-DD`` text (``_portable``); the library functions
themselves keep DECIMAL money and DATE columns.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from claimspark import operators as ops  # noqa: E402
from claimspark.operators.key_index import KeyIndex, ReferenceIndex  # noqa: E402
from claimspark.plans import investigations as inv  # noqa: E402
from claimspark.plans import models, one_scan, profiles, rules  # noqa: E402
from claimspark.plans.features import claim_features, claim_flags, disease_means  # noqa: E402
from claimspark.plans.models_full import FullModels, model_rows  # noqa: E402
from claimspark.schemas import CLAIMS, FOREIGN_KEYS, INVESTIGATIONS, PATIENTS, PRIMARY_KEYS, \
    PROVIDER_RISK, PROVIDERS  # noqa: E402
from claimspark.session import shared_dir, stored  # noqa: E402
from claimspark.sources import catalog, layout, readers, sinks  # noqa: E402
from claimspark.sources.mapping import load_tables, materialized_claims_path, read_raw  # noqa: E402
from claimspark.streaming import start_flagging  # noqa: E402
from oracle_queries import ORACLE  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from claimspark.llm import queries as llm_queries
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "claimspark.llm"):  # present, but something in it is missing
        raise
    LLM_QUERIES, LLM_ORACLE = {}, {}
else:
    LLM_QUERIES = llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    LLM_ORACLE = dict(llm_queries.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        LLM_ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

SMOKE_DIR = "/root/testdata/sf0.001"


def _portable(df: DataFrame) -> DataFrame:
    """DECIMAL -> DOUBLE, DATE -> 'YYYY-MM-DD' text; everything else unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _t(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The claims tables mapped from ``sf_dir``, written once per session to
    the shared checkpoint folder (the ingest step) and then scanned."""
    return load_tables(spark, sf_dir, materialize=True)


# --- the eight named queries ------------------------------------------------

def q1_claim_inflation(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rules.claim_inflation(t["claims"], t["patients"])


def q2_duplicate_pairs(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rules.duplicate_pairs(t["claims"], t["patients"])


def q2_duplicate_pairs_symmetric(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rules.duplicate_pairs(t["claims"], t["patients"], symmetric=True)


def q2_duplicate_pairs_sweep(spark, sf_dir):
    """Query 2 over range partitions that exchange halos."""
    t = _t(spark, sf_dir)
    return rules.duplicate_pairs(t["claims"], t["patients"], sweep=True)


def q3_non_empanelled_high_value(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rules.non_empanelled_high_value(t["claims"], t["patients"], t["providers"])


def q4_procedure_burst(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rules.procedure_burst(t["claims"], t["patients"])


def q5_provider_rank(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profiles.provider_rank(t["claims"], t["providers"])


def provider_fraud_ranks(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profiles.provider_fraud_ranks(t["claims"], t["providers"])


def q6_monthly_trend(spark, sf_dir):
    return profiles.monthly_trend(_t(spark, sf_dir)["claims"])


def q7_disease_profile(spark, sf_dir):
    return profiles.disease_profile(_t(spark, sf_dir)["claims"])


def q8_kyc_high_claims(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rules.kyc_high_claims(t["claims"], t["patients"])


def q8_kyc_high_claims_reduced(spark, sf_dir):
    """Query 8 over the claims that a semi-join reduction leaves."""
    t = _t(spark, sf_dir)
    return rules.kyc_high_claims(t["claims"], t["patients"], reduce=True)


_BY_MONTH: dict[tuple, DataFrame] = {}


def q6_months_of_recoveries(spark, sf_dir):
    """Query 6 for the three months in which investigations recovered most, from
    claims stored by month: only those months' files are read."""
    t = _t(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BY_MONTH:
        _BY_MONTH[key] = layout.write_by_month(t["claims"], shared_dir(spark, "claims-by-month"), "claim_date")
    month = F.date_format("investigation_date", models.FV.MONTH_FORMAT).alias("month")
    most = (t["investigations"].filter("investigation_date IS NOT NULL").groupBy(month)
            .agg(F.sum("amount_recovered").alias("recovered")).orderBy(F.desc("recovered"), "month").limit(3))
    return profiles.monthly_trend(layout.months_of(_BY_MONTH[key], stored(most, "months")).drop("month"))


_COLOCATED: dict[tuple, layout.Colocated] = {}


def _colocated(spark, sf_dir) -> layout.Colocated:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _COLOCATED:
        t = _t(spark, sf_dir)
        _COLOCATED[key] = layout.save_colocated(spark, t["claims"], {"patients": t["patients"]}, "patient_id",
                                                f"colocated_{uuid.uuid4().hex[:8]}",
                                                buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _COLOCATED[key]


def claim_features_colocated(spark, sf_dir):
    """The feature frame from claims and patients stored in buckets of the patient."""
    t = _t(spark, sf_dir)
    means = disease_means(t["claims"])
    return _colocated(spark, sf_dir).apply(
        lambda facts, dims: claim_features(facts, dims["patients"], t["providers"], means))


def eda_one_scan(spark, sf_dir):
    """The count tables of the charts from one scan, one below the other."""
    parts = []
    for name, df in sorted(one_scan.count_tables(_t(spark, sf_dir)["claims"]).items()):
        row = [F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns if df.schema[c].dataType != T.DoubleType()])]
        rate = [c for c in df.columns if df.schema[c].dataType == T.DoubleType()]
        parts.append(df.select(F.lit(name).alias("table_name"), row[0].alias("cells"),
                               (F.round(rate[0], 6) if rate else F.lit(None).cast("double")).alias("rate")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _features(spark, sf_dir):
    t = _t(spark, sf_dir)
    return claim_features(t["claims"], t["patients"], t["providers"])


def _flags(spark, sf_dir):
    """Claim-level derived columns only (no dimension joins): enough for the
    evaluation tables and the KPIs."""
    return claim_flags(_t(spark, sf_dir)["claims"])


# --- aggregates and EDA tables -------------------------------------------------

def disease_avg(spark, sf_dir):
    return disease_means(_t(spark, sf_dir)["claims"]).orderBy("disease_category")


def claim_features_q(spark, sf_dir):
    return _features(spark, sf_dir)


def eda_class_balance(spark, sf_dir):
    return ops.class_balance(_t(spark, sf_dir)["claims"], "is_fraud")


def eda_fraud_type_counts(spark, sf_dir):
    return ops.value_counts(_t(spark, sf_dir)["investigations"], "fraud_type")


def eda_rate_by_disease(spark, sf_dir):
    return ops.rate_by(_t(spark, sf_dir)["claims"], "disease_category", "is_fraud")


def eda_rate_by_policy(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profiles.rate_by_patient_attribute(t["claims"], t["patients"], "policy_type")


def eda_monthly(spark, sf_dir):
    return ops.monthly_counts(_t(spark, sf_dir)["claims"], "claim_date", "is_fraud")


def eda_recovered_by_status(spark, sf_dir):
    return ops.sum_by(_t(spark, sf_dir)["investigations"], "status", "amount_recovered",
                      "amount_recovered")


def eda_amount_hist(spark, sf_dir):
    return profiles.amount_histogram(_t(spark, sf_dir)["claims"])


def eda_ratio_hist(spark, sf_dir):
    return profiles.ratio_histogram(_t(spark, sf_dir)["claims"])


def eda_stay_procedure_grid(spark, sf_dir):
    return profiles.stay_procedure_grid(_t(spark, sf_dir)["claims"])


def provider_risk(spark, sf_dir):
    return profiles.risk_profile(_t(spark, sf_dir)["claims"], "provider_id")


def provider_rate_hist(spark, sf_dir):
    return profiles.rate_histogram(provider_risk(spark, sf_dir))


def provider_top_high(spark, sf_dir):
    return profiles.top_high_risk(provider_risk(spark, sf_dir), "provider_id")


def patient_risk(spark, sf_dir):
    return profiles.risk_profile(_t(spark, sf_dir)["claims"], "patient_id")


def patient_risk_tiers(spark, sf_dir):
    return profiles.tier_counts(patient_risk(spark, sf_dir))


def patient_top_high(spark, sf_dir):
    return profiles.top_high_risk(patient_risk(spark, sf_dir), "patient_id")


def kpi_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profiles.kpi_summary(t["patients"], t["providers"], claim_flags(t["claims"]),
                                t["investigations"])


# --- evaluation on a deterministic score (inflation ratio / is_inflated) ------

def eval_confusion(spark, sf_dir):
    return ops.confusion_matrix(_flags(spark, sf_dir), "is_fraud", "is_inflated")


def eval_report(spark, sf_dir):
    return ops.classification_report(_flags(spark, sf_dir), "is_fraud", "is_inflated")


def eval_roc(spark, sf_dir):
    return ops.roc_points(_flags(spark, sf_dir), "is_fraud", "inflation_ratio")


def eval_auc(spark, sf_dir):
    return ops.auc(_flags(spark, sf_dir), "is_fraud", "inflation_ratio")


# --- investigations, data quality ---------------------------------------------

def open_investigations(spark, sf_dir):
    return inv.open_investigations(_t(spark, sf_dir)["claims"])


def open_investigations_exact(spark, sf_dir):
    """Investigations of exactly three quarters of the fraud claims."""
    return inv.open_investigations(_t(spark, sf_dir)["claims"], exact=True)


def dq_key_violations(spark, sf_dir):
    return ops.key_report(_t(spark, sf_dir), PRIMARY_KEYS)


def dq_key_violations_lineitem(spark, sf_dir):
    li = read_raw(spark, sf_dir, "lineitem")
    return ops.key_violations(li.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def _batches(df, keys, n=3):
    """The rows in ``n`` batches by the hash of a key."""
    part = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [df.filter(part == i) for i in range(n)]


def dq_key_index(spark, sf_dir):
    """The key report of every table kept up over three batches of it."""
    out = None
    for name, keys in PRIMARY_KEYS.items():
        rows = _t(spark, sf_dir)[name].select(*keys)
        index = KeyIndex(keys)
        for batch in _batches(rows, keys):
            index.add(batch)
        part = index.report(rows, name)
        out = part if out is None else out.unionByName(part)
    return out


def dq_reference_index(spark, sf_dir):
    """The orphan report kept up over batches of children before, between and after the parents."""
    t, found = _t(spark, sf_dir), []
    for child, ck, parent, pk in FOREIGN_KEYS:
        index = ReferenceIndex(ck, pk)
        children, parents = _batches(t[child].select(ck), [ck]), _batches(t[parent].select(pk), [pk], 2)
        index.add_children(children[0])
        index.add_parents(parents[0])
        index.add_children(children[1])
        index.add_parents(parents[1])
        index.add_children(children[2])
        found.append((f"{child}.{ck}", f"{parent}.{pk}", index.orphans()))
    return spark.createDataFrame(found, "foreign_key string, references string, n_orphans bigint")  # a row a foreign key


def dq_orphans(spark, sf_dir):
    return ops.orphan_report(_t(spark, sf_dir), FOREIGN_KEYS)


# --- catalog, sources, sinks: round trips through the shared folder -----------

def register_views(spark, sf_dir):
    names = catalog.register_views(spark, _t(spark, sf_dir))
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows FROM {n}" for n in names))


def create_database(spark, sf_dir):
    """The four tables in a database of their own, found through the catalog
    while it is the current one; the session then returns to its former one."""
    before = spark.catalog.currentDatabase()
    name = f"claims_{uuid.uuid4().hex[:8]}"
    try:
        tables = catalog.save_tables(spark, _t(spark, sf_dir), name)
        found = {r.name for r in spark.catalog.listTables(name)}
        parts = [f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows, {str(t in found).lower()} AS listed, "
                 f"current_database() = '{name}' AS is_current FROM {t}" for t in tables]
        return stored(spark.sql(" UNION ALL ".join(parts)), "database")
    finally:
        spark.catalog.setCurrentDatabase(before)


_FOLDERS: dict[tuple, str] = {}


def _folder(spark, sf_dir, name):
    """One folder per application, input and purpose: a query that runs again
    writes over its last copy instead of leaving another."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    return _FOLDERS.setdefault(key, shared_dir(spark, name))


def _csv_round_trip(spark, sf_dir, df, schema, name):
    path = _folder(spark, sf_dir, name)
    sinks.write_table(df, path, "csv", compression="gzip")
    return readers.read_table(spark, path, schema, "csv")


def src_patients(spark, sf_dir):
    return _csv_round_trip(spark, sf_dir, _t(spark, sf_dir)["patients"], PATIENTS, "patients-csv")


def src_providers(spark, sf_dir):
    return _csv_round_trip(spark, sf_dir, _t(spark, sf_dir)["providers"], PROVIDERS, "providers-csv")


def src_claims(spark, sf_dir):
    return _csv_round_trip(spark, sf_dir, _t(spark, sf_dir)["claims"], CLAIMS, "claims-csv")


def src_investigations(spark, sf_dir):
    return _csv_round_trip(spark, sf_dir, _t(spark, sf_dir)["investigations"], INVESTIGATIONS,
                           "investigations-csv")


def ingest_csv(spark, sf_dir):
    csv_path = _folder(spark, sf_dir, "claims-raw-csv")
    sinks.write_table(_t(spark, sf_dir)["claims"], csv_path, "csv")
    accepted, _rejected = readers.ingest_csv(spark, csv_path, CLAIMS, _folder(spark, sf_dir, "claims-ingested"))
    return accepted


def write_provider_risk(spark, sf_dir):
    path = _folder(spark, sf_dir, "provider-risk")
    sinks.write_provider_risk(provider_risk(spark, sf_dir), path)
    return readers.read_table(spark, path, PROVIDER_RISK, "csv")


_ANALYSIS = T.StructType([
    T.StructField("claim_id", T.StringType()), T.StructField("patient_id", T.StringType()),
    T.StructField("provider_id", T.StringType()), T.StructField("disease_category", T.StringType()),
    T.StructField("claim_amount", T.DecimalType(12, 2)), T.StructField("days_hospitalised", T.IntegerType()),
    T.StructField("num_procedures", T.IntegerType()), T.StructField("is_fraud", T.IntegerType()),
    T.StructField("inflation_ratio", T.DoubleType()), T.StructField("suspicious_pattern", T.IntegerType()),
    T.StructField("duplicate_claim", T.IntegerType()),
])


def write_claims_analysis(spark, sf_dir):
    path = _folder(spark, sf_dir, "claims-analysis")
    sinks.write_claims_analysis(_flags(spark, sf_dir), path)
    return readers.read_table(spark, path, _ANALYSIS, "csv")


def write_table(spark, sf_dir):
    path = _folder(spark, sf_dir, "investigations-parquet")
    sinks.write_table(_t(spark, sf_dir)["investigations"], path, "parquet", partition_by=["status"])
    return spark.read.parquet(path)


# --- streaming: the per-claim flags as a Structured Streaming job ------------

STREAM_COLUMNS = ["claim_id", "patient_id", "disease_category", "inflation_ratio",
                  "suspicious_pattern", "is_inflated", "kyc_risk", "not_empanelled"]


def stream_claim_flags(spark, sf_dir):
    """Replay the claims table as a file stream (availableNow), flag every claim
    against static patients / providers / category means, append to a Parquet
    sink (checkpointed in the shared folder) and return what the sink holds."""
    t = _t(spark, sf_dir)
    stream = (spark.readStream.schema(t["claims"].schema)
              .parquet(materialized_claims_path(spark, sf_dir))
              .select(*t["claims"].columns))
    sink = shared_dir(spark, "stream-flags")
    q = start_flagging(spark, stream, t["patients"], t["providers"], disease_means(t["claims"]),
                       sink, checkpoint=shared_dir(spark, "stream-flags-ckpt"), available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink).select(*STREAM_COLUMNS)


# --- model preparation and models ---------------------------------------------

def ml_encode(spark, sf_dir):
    enc = models.encode(_features(spark, sf_dir))
    return enc.select("claim_id", *[o for _, o in models.FV.CATEGORICAL_FEATURES])


def ml_complete_rows(spark, sf_dir):
    return models.complete_rows(models.encode(_features(spark, sf_dir))).select("claim_id", "is_fraud")


def ml_split(spark, sf_dir):
    # id and label are claim columns: no dimension joins needed
    return ops.hash_split(_t(spark, sf_dir)["claims"].select("claim_id", "is_fraud"), "claim_id")


def ml_split_exact(spark, sf_dir):
    return ops.exact_stratified_split(_t(spark, sf_dir)["claims"].select("claim_id", "is_fraud"),
                                      "claim_id", "is_fraud")


# The registered models are fitted on every training row with the library's defaults: 100
# trees grown until they are pure, 100 rounds of depth 6, Newton steps to convergence;
# every test row is scored.  Fitted models are kept per application and folder.
MODEL_ARGS: dict = {}
_MODELS: dict = {}


def _models(spark, sf_dir) -> FullModels:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = FullModels(model_rows(_features(spark, sf_dir)), **MODEL_ARGS)
    return _MODELS[key]


def ml_assemble(spark, sf_dir):
    """The feature vector of every complete row as 20 columns, and the split."""
    rows = models.prepare(_features(spark, sf_dir)).withColumn("v", models.vector_to_array("features"))
    return rows.select("claim_id", F.col("label").cast("int").alias("label"), "is_test",
                       *[F.col("v")[i].alias(name) for i, name in enumerate(models.FEATURES)])


def ml_scale(spark, sf_dir):
    """Every test row with its 20 features scaled by the moments of all training rows."""
    rows = _models(spark, sf_dir).scaled_test()
    return rows.select("claim_id", F.col("label").cast("int").alias("label"),
                       *[F.round(c, 6).alias(c) for c in models.FEATURES])


def ml_moments(spark, sf_dir):
    """Rows, mean and population deviation of each feature over all training rows,
    and the same of the scaled training rows."""
    m = _models(spark, sf_dir)
    found = m.moments()
    scaled = found.apply(m.train).agg(*[e for i, c in enumerate(models.FEATURES) for e in (
        F.round(F.abs(F.avg(c)), 6).alias(f"m{i}"), F.round(F.stddev_pop(c), 6).alias(f"s{i}"))])
    rows = [F.struct(F.lit(name).alias("feature"), F.lit(found.n).cast("bigint").alias("n_rows"),
                     F.lit(round(found.mean[i], 6)).alias("mean"), F.lit(round(found.deviation[i], 6)).alias("deviation"),
                     F.col(f"m{i}").alias("scaled_mean"), F.col(f"s{i}").alias("scaled_deviation"))
            for i, name in enumerate(models.FEATURES)]
    return scaled.select(F.inline(F.array(*rows)))


def ml_logistic(spark, sf_dir):
    """Every test row with its probability and class."""
    return _models(spark, sf_dir).scored("logistic")


def ml_forest(spark, sf_dir):
    return _models(spark, sf_dir).scored("forest")


def ml_boosted(spark, sf_dir):
    return _models(spark, sf_dir).scored("boosted")


def ml_score(spark, sf_dir):
    """Every test row once with the probabilities and classes of all three models."""
    return _models(spark, sf_dir).scores()


def ml_compare(spark, sf_dir):
    return _models(spark, sf_dir).comparison()


def ml_importance_top(spark, sf_dir):
    return _models(spark, sf_dir).importances()


def ml_coefficients(spark, sf_dir):
    return _models(spark, sf_dir).coefficients()


def ml_splits(spark, sf_dir):
    """Every split of the boosted trees: feature, threshold, gain, rows."""
    return _models(spark, sf_dir).splits("boosted")


def eval_model_report(spark, sf_dir):
    return ops.classification_report(_models(spark, sf_dir).scored("boosted"), "label", "prediction")


def eval_model_confusion(spark, sf_dir):
    return ops.confusion_matrix(_models(spark, sf_dir).scored("boosted"), "label", "prediction")


def eval_model_roc(spark, sf_dir):
    return ops.roc_points(_models(spark, sf_dir).scored("boosted"), "label", "probability")


# What SQL can know of fitted models, beside their values.

def _facts(spark, sf_dir, which):
    """Every test row, and whether its probability and class are sound: between
    0 and 1, and the class that of a threshold of one half."""
    rows = _models(spark, sf_dir).scored(which)
    p = F.col("probability")
    return rows.select("claim_id", "label", p.between(0, 1).alias("in_range"),
                       ((p > 0.5).cast("int") == F.col("prediction")).alias("class_follows"))


def ml_logistic_facts(spark, sf_dir):
    return _facts(spark, sf_dir, "logistic")


def ml_forest_facts(spark, sf_dir):
    return _facts(spark, sf_dir, "forest")


def ml_boosted_facts(spark, sf_dir):
    return _facts(spark, sf_dir, "boosted")


def ml_score_facts(spark, sf_dir):
    """Every test row once with the number of models that scored it."""
    scored = [F.col(f"probability_{m}").isNotNull().cast("int") for m in models.MODELS]
    return _models(spark, sf_dir).scores().select("claim_id", "label", sum(scored).alias("n_scores"))


def ml_compare_facts(spark, sf_dir):
    """Each model's test rows per class, and whether its AUC is above 0.8."""
    out = _models(spark, sf_dir).comparison()
    return out.select("model", "n_pos", "n_neg", (F.col("auc") > 0.8).alias("auc_above_floor"))


def ml_importance_top_facts(spark, sf_dir):
    """The twelve places of the importance table: whether each holds a model
    feature with a share, and no larger one than the place before."""
    table = _models(spark, sf_dir).importances()
    order = Window.orderBy(F.col("importance").desc(), "feature")  # at most twelve rows
    ranked = table.withColumns({"place": F.row_number().over(order), "before": F.lag("importance").over(order)})
    return ranked.select("place", F.col("feature").isin(models.FEATURES).alias("is_feature"),
                         F.col("importance").between(0, 1).alias("is_share"),
                         F.coalesce(F.col("importance") <= F.col("before"), F.lit(True)).alias("in_order"))


def eval_model_report_facts(spark, sf_dir):
    """The report's rows with their support, and whether every figure is a share."""
    out = eval_model_report(spark, sf_dir)
    share = [F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in ("precision", "recall", "f1_score")]
    return out.select("class_name", "support", (share[0] & share[1] & share[2]).alias("in_range"))


def eval_model_confusion_facts(spark, sf_dir):
    """The rows of the confusion matrix with their totals."""
    return eval_model_confusion(spark, sf_dir).select("actual", (F.col("predicted_0") + F.col("predicted_1")).alias("support"))


def eval_model_roc_facts(spark, sf_dir):
    """The curve's two ends, and whether it starts with no row counted."""
    ends = eval_model_roc(spark, sf_dir).agg(
        F.min("tp").alias("tp0"), F.min("fp").alias("fp0"), F.max("tp").alias("tp1"), F.max("fp").alias("fp1"),
        F.max("tpr").alias("tpr1"), F.max("fpr").alias("fpr1"),
        F.max_by(F.col("tp") + F.col("fp"), F.col("threshold")).alias("at_top"))

    def end(name, tp, fp, tpr, fpr, ok):
        values = {"point": F.lit(name), "tp": tp, "fp": fp, "tpr": tpr, "fpr": fpr, "ok": ok}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    c = F.col
    return ends.select(F.inline(F.array(
        end("start", c("tp0"), c("fp0"), F.lit(0.0), F.lit(0.0), c("at_top") == 0),
        end("end", c("tp1"), c("fp1"), c("tpr1"), c("fpr1"), F.lit(True)))))


#: What a fit returns, which SQL has no counterpart of; each has its ``_facts``, and the
#: tests recompute splits, gradients and moments by SQL.
FITTED = ["ml_logistic", "ml_forest", "ml_boosted", "ml_score", "ml_compare", "ml_importance_top",
          "eval_model_report", "eval_model_confusion", "eval_model_roc"]
#: Everything that waits for the fits.
MODEL_KEYS = {"ml_assemble", "ml_scale", "ml_moments", "ml_coefficients", "ml_splits", *FITTED, *(f"{k}_facts" for k in FITTED)}


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q1_claim_inflation": q1_claim_inflation,
    "q2_duplicate_pairs": q2_duplicate_pairs,
    "q2_duplicate_pairs_symmetric": q2_duplicate_pairs_symmetric,
    "q2_duplicate_pairs_sweep": q2_duplicate_pairs_sweep,
    "q3_non_empanelled_high_value": q3_non_empanelled_high_value,
    "q4_procedure_burst": q4_procedure_burst,
    "q5_provider_rank": q5_provider_rank,
    "provider_fraud_ranks": provider_fraud_ranks,
    "q6_monthly_trend": q6_monthly_trend,
    "q7_disease_profile": q7_disease_profile,
    "q8_kyc_high_claims": q8_kyc_high_claims,
    "q8_kyc_high_claims_reduced": q8_kyc_high_claims_reduced,
    "q6_months_of_recoveries": q6_months_of_recoveries,
    "claim_features_colocated": claim_features_colocated,
    "eda_one_scan": eda_one_scan,
    "disease_avg": disease_avg,
    "claim_features": claim_features_q,
    "eda_class_balance": eda_class_balance,
    "eda_fraud_type_counts": eda_fraud_type_counts,
    "eda_rate_by_disease": eda_rate_by_disease,
    "eda_rate_by_policy": eda_rate_by_policy,
    "eda_monthly": eda_monthly,
    "eda_recovered_by_status": eda_recovered_by_status,
    "eda_amount_hist": eda_amount_hist,
    "eda_ratio_hist": eda_ratio_hist,
    "eda_stay_procedure_grid": eda_stay_procedure_grid,
    "provider_risk": provider_risk,
    "provider_rate_hist": provider_rate_hist,
    "provider_top_high": provider_top_high,
    "patient_risk": patient_risk,
    "patient_risk_tiers": patient_risk_tiers,
    "patient_top_high": patient_top_high,
    "kpi_summary": kpi_summary,
    "eval_confusion": eval_confusion,
    "eval_report": eval_report,
    "eval_roc": eval_roc,
    "eval_auc": eval_auc,
    "open_investigations": open_investigations,
    "open_investigations_exact": open_investigations_exact,
    "dq_key_violations": dq_key_violations,
    "dq_key_violations_lineitem": dq_key_violations_lineitem,
    "dq_orphans": dq_orphans,
    "dq_key_index": dq_key_index,
    "dq_reference_index": dq_reference_index,
    "register_views": register_views,
    "create_database": create_database,
    "src_patients": src_patients,
    "src_providers": src_providers,
    "src_claims": src_claims,
    "src_investigations": src_investigations,
    "ingest_csv": ingest_csv,
    "write_provider_risk": write_provider_risk,
    "write_claims_analysis": write_claims_analysis,
    "write_table": write_table,
    "stream_claim_flags": stream_claim_flags,
    "ml_encode": ml_encode,
    "ml_complete_rows": ml_complete_rows,
    "ml_split": ml_split,
    "ml_split_exact": ml_split_exact,
    "ml_assemble": ml_assemble,
    "ml_scale": ml_scale,
    "ml_moments": ml_moments,
    "ml_logistic": ml_logistic,
    "ml_forest": ml_forest,
    "ml_boosted": ml_boosted,
    "ml_score": ml_score,
    "ml_compare": ml_compare,
    "ml_importance_top": ml_importance_top,
    "ml_coefficients": ml_coefficients,
    "ml_splits": ml_splits,
    "eval_model_report": eval_model_report,
    "eval_model_confusion": eval_model_confusion,
    "eval_model_roc": eval_model_roc,
    "ml_logistic_facts": ml_logistic_facts,
    "ml_forest_facts": ml_forest_facts,
    "ml_boosted_facts": ml_boosted_facts,
    "ml_score_facts": ml_score_facts,
    "ml_compare_facts": ml_compare_facts,
    "ml_importance_top_facts": ml_importance_top_facts,
    "eval_model_report_facts": eval_model_report_facts,
    "eval_model_confusion_facts": eval_model_confusion_facts,
    "eval_model_roc_facts": eval_model_roc_facts,
}


def _wrap(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _portable(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def entry(spark: SparkSession) -> DataFrame:
    return _portable(q1_claim_inflation(spark, SMOKE_DIR))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _wrap(v) for k, v in _QUERIES.items()} | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each key of ``queries()`` that has an SQL equivalent."""
    return {k: v for k, v in ORACLE.items() if k in _QUERIES} | LLM_ORACLE
