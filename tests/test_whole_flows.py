"""Fitted and generated flows run to their tolerance, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from terrano.plans import flows
from terrano.plans.base import Tables

SF = "/root/testdata/sf0.001"


def dense(df, value="value"):
    m = np.zeros((25, 25))
    for r in df.collect():
        m[r.n, r.i] = r[value]
    return m


def test_generated_flows(spark):
    t = Tables(spark, SF)
    m, tau = dense(flows.matrix(t)), dense(flows.times(t), "tau")
    u, r, jobs, b = (1 + np.arange(25) / 50) ** 4.6 * tau ** (-4.6 * 0.47), m.sum(1), m.sum(0), np.ones(25)
    u[:, jobs == 0] = 0
    for _ in range(2000):
        want = b * u / (b * u).sum(1, keepdims=True) * r[:, None]
        if 100 * np.abs(jobs - want.sum(0)).sum() < 1e-3:
            break
        b = np.where(jobs > 0, b * jobs / np.where(jobs > 0, want.sum(0), 1), 0)
    got = dense(entry.queries()["flows_generated"](spark, SF))
    assert got.sum(0) == pytest.approx(jobs, abs=1e-3) and got == pytest.approx(want, abs=1e-4)


def test_fitted_flows(spark):
    t = Tables(spark, SF)
    m, (r, c) = dense(flows.matrix(t)), flows.targets(t)
    rows, cols = np.zeros(25), np.zeros(25)
    for x in r.collect():
        rows[x.n] = x.r
    for x in c.collect():
        cols[x.i] = x.c
    total = (rows.sum() + cols.sum()) / 2
    rows, cols, m = rows * total / rows.sum(), cols * total / cols.sum(), np.where(m > 0, m + 1e-6, 0)
    for _ in range(200):
        m *= (rows / np.maximum(m.sum(1), 1e-300))[:, None]
        m *= cols / np.where(m.sum(0) > 0, m.sum(0), 1)
    assert dense(entry.queries()["ipf_converged"](spark, SF)) == pytest.approx(m, abs=1e-4)
