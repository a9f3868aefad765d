"""Rows for the tests' claims tables."""

import datetime as dt
from decimal import Decimal


def D(s):
    return dt.date.fromisoformat(s)


def M(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


def claim(cid, pid="P1", prov="V1", disease="Cardiac", amount=1000, days=3, procs=2,
          date="2024-01-10", dup=0, emp=1, status="Approved", fraud=0):
    return (cid, pid, prov, disease, M(amount), days, procs, D(date), dup, emp, status, fraud)


def patient(pid, name=None, kyc="Yes", policy="Individual", age=40, gender="Male", tier="Basic"):
    return (pid, name or f"name-{pid}", age, gender, "Pune", policy, tier, D("2020-01-01"), kyc)


def provider(vid, name=None, empanelled="Yes", ptype="Private"):
    return (vid, name or f"hospital-{vid}", "Pune", ptype, empanelled)
