"""claimspark: payment-integrity analytics on claims-like tables, on Spark DataFrames.

Typical use::

    from claimspark.plans.report import read_inputs, result_tables
    from claimspark.plans import rules, profiles
    from claimspark.plans.features import claim_features

    t = read_inputs(spark, "/data/claims", fmt="parquet")
    q1 = rules.claim_inflation(t["claims"], t["patients"])        # Query 1
    q5 = profiles.provider_rank(t["claims"], t["providers"])      # Query 5
    feats = claim_features(t["claims"], t["patients"], t["providers"])
    tables = result_tables(t)                                     # every result, lazily

or, for the whole analysis, ``python -m claimspark IN_DIR OUT_DIR``.  The
operators in ``claimspark.operators`` are generic: they take DataFrames and
column names, not the claims schema.
"""

__version__ = "0.1.0"
