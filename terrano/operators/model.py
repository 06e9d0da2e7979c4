"""Kernels of the quantitative model on dense matrices packed from long tables.

A calibration holds a few N x N matrices (N about 2,500: 50 MB each), so one task solves one group;
`group` columns solve many calibrations side by side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def productivity(jobs, residents, wages, incomes, cost, sigma=4.0, nu=0.05, fixed=1.0, relax=0.25, rounds=20_000, tol=1e-8):
    """(A, price index, trade shares by column, gap): A balances income and expenditure in every place."""
    a = np.ones(len(jobs))
    d = cost ** (1 - sigma)
    scale = jobs ** (1 - (1 - sigma) * nu) * wages ** (1 - sigma)
    income, spend = wages * jobs, incomes * residents
    gap = np.inf
    for _ in range(rounds):
        x = d * (a ** (sigma - 1) * scale)
        share = x / x.sum(1, keepdims=True)
        got = share.T @ spend
        gap = float(np.abs(income - got).max())
        if gap < tol or not np.round(income - got, 6).any():
            break
        a = relax * a * income / got + (1 - relax) * a
        a /= a.mean()
    x = d * (a ** (sigma - 1) * scale)[:, None]
    share = x / x.sum(0, keepdims=True)
    own = np.diag(share)
    price = sigma / (sigma - 1) * (jobs / (sigma * fixed * own)) ** (1 / (1 - sigma)) * wages / a
    return a, price, share, gap


def counterfactual(a, b, kappa, d, w0, v0, lam0, l0, r0, pi0, alpha=0.7, eps=4.6, delta=0.38, sigma=4.0, nu=0.05, tol=1e-4, rounds=100_000, relax=0.25):
    """Exact-hat changes: dict of w, v, l, r, q, pi, p, lam and welfare for changes a, b, kappa, d of a base state."""
    n = len(w0)
    w, lam, total = np.ones(n), np.ones((n, n)), l0.sum()
    d1, ke = d ** (1 - sigma), kappa ** (-eps)

    def state(w, lam):
        base = b * lam0 * ke
        v = (base * w ** (1 + eps) * w0).sum(1) / (base * w**eps).sum(1) / v0
        l = total * (lam0 * lam).sum(0) / l0
        r = total * (lam0 * lam).sum(1) / r0
        q = (v * r) ** (1 / (1 + delta))
        m = a ** (sigma - 1) * l ** (1 - (1 - sigma) * nu) * w ** (1 - sigma)
        x = d1 * m[:, None]
        pi = x / (pi0 * x).sum(0, keepdims=True)
        p = (l ** (1 - (1 - sigma) * nu) / np.diag(pi)) ** (1 / (1 - sigma)) * np.diag(d) * w / a
        return v, l, r, q, pi, p

    for k in range(rounds):
        v, l, r, q, pi, p = state(w, lam)
        new = (pi0 * pi) @ (v * r * v0 * r0) / (w0 * l0 * l)
        new = new * w0 / (new * w0).mean() / w0
        x = b * ((p**alpha * q ** (1 - alpha)) ** (-eps))[:, None] * (w / kappa) ** eps
        lam_new = x / (lam0 * x).sum()
        ended = np.abs(w - new).max() < tol and np.abs(lam - lam_new).max() < tol
        w, lam = (new, lam_new) if ended else (relax * new + (1 - relax) * w, relax * lam_new + (1 - relax) * lam)
        if ended:
            break
    v, l, r, q, pi, p = state(w, lam)
    welfare = b ** (1 / eps) / (kappa * (p**alpha * q ** (1 - alpha))[:, None]) * w * lam ** (-1 / eps)
    return {"w": w, "v": v, "l": l, "r": r, "q": q, "pi": pi, "p": p, "lam": lam, "welfare": float(welfare[0, 0]), "spread": float(welfare.std()), "rounds": k + 1}


def packed(pdf, n: int, value: str) -> np.ndarray:
    out = np.zeros((n, n))
    out[pdf["n"].to_numpy(int), pdf["i"].to_numpy(int)] = pdf[value]
    return out


def calibrated(od: DataFrame, sigma=4.0, nu=0.05, eps=4.6, mu=0.47, alpha=0.7) -> DataFrame:
    """(code, a, price, amenity, cma, gap) for a long table (grp, n, i, value, tau, d, w, q): n, i are positions 0..N-1,
    w the workplace's wage, q the observed price of floor space at the residence."""
    def each(pdf):
        import pandas as pd

        n = int(max(pdf["n"].max(), pdf["i"].max())) + 1
        com, tau, d = (packed(pdf, n, c) for c in ("value", "tau", "d"))
        wage = np.ones(n)
        wage[pdf["i"].to_numpy(int)] = pdf["w"]
        res, jobs = com.sum(1), com.sum(0)
        res, jobs = res / res.mean(), jobs / jobs.mean()
        cond = com / com.sum(1, keepdims=True)
        v = cond @ wage
        # incomes are scaled so that what is earned can be spent
        v = v * (wage * jobs).sum() / (v * res).sum()
        a, price, _, gap = productivity(jobs, res, wage, v, d, sigma, nu)
        rent = np.ones(n)
        rent[pdf["n"].to_numpy(int)] = pdf["q"]
        cma = (tau ** (-eps * mu) * wage**eps).sum(1)
        b = res / jobs.sum() * (price**alpha * rent ** (1 - alpha)) ** eps / cma
        b /= np.exp(np.log(b).mean())
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "code": np.arange(n), "a": a, "price": price, "amenity": b, "cma": cma, "gap": gap})

    return od.groupBy("grp").applyInPandas(each, "grp int, code int, a double, price double, amenity double, cma double, gap double")


def network_effect(od: DataFrame, sigma=4.0, nu=0.05, eps=4.6, alpha=0.7, delta=0.38) -> DataFrame:
    """(grp, welfare, spread, sd_r, sd_l, rounds) of new travel times, for (grp, n, i, value, tau, tau_new, d, w).

    The base is the calibrated state: trade shares by the productivities that balance income and expenditure.
    """
    def each(pdf):
        import pandas as pd

        n = int(max(pdf["n"].max(), pdf["i"].max())) + 1
        com, tau, new, d = (packed(pdf, n, c) for c in ("value", "tau", "tau_new", "d"))
        wage = np.ones(n)
        wage[pdf["i"].to_numpy(int)] = pdf["w"]
        wage /= wage.mean()  # the wage level is a numeraire
        res, jobs = com.sum(1), com.sum(0)
        res, jobs = res / res.mean(), jobs / jobs.mean()
        v0 = (com / com.sum(1, keepdims=True)) @ wage
        _, _, share, _ = productivity(jobs, res, wage, v0, d, sigma, nu)
        ones = np.ones((n, n))
        out = counterfactual(np.ones(n), ones, new / tau, ones, wage, v0, com / com.sum(), jobs, res, share, alpha, eps, delta, sigma, nu)
        return pd.DataFrame([(pdf["grp"].iloc[0], out["welfare"], out["spread"], float(np.log(out["r"]).std()), float(np.log(out["l"]).std()), out["rounds"])], columns=["grp", "welfare", "spread", "sd_r", "sd_l", "rounds"])

    return od.groupBy("grp").applyInPandas(each, "grp int, welfare double, spread double, sd_r double, sd_l double, rounds int")


def invariants(state: DataFrame, total: float, tau: DataFrame | None = None, balance: DataFrame | None = None) -> DataFrame:
    """(check, passed, value) for one row per place (l, r, a, b, uncond), times (tau) and (income, expenditure) by place; what is null fails."""
    def row(name, ok, value):
        return F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), value.cast("double").alias("value"))

    def checks(df, *rows):
        return df.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    s = state.agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum("uncond").alias("u"), F.min("a").alias("a"), F.exp(F.avg(F.ln("b"))).alias("b"))
    out = checks(s, row("jobs", F.abs(F.col("l") - total) < 1e-3, F.col("l")), row("residents", F.abs(F.col("r") - total) < 1e-3, F.col("r")),
                 row("shares", F.abs(F.col("u") - 1) < 1e-8, F.col("u")), row("productivity", F.col("a") > 0, F.col("a")), row("amenity", F.abs(F.col("b") - 1) < 1e-6, F.col("b")))
    if tau is not None:
        finite = F.col("tau").isNotNull() & ~F.isnan("tau") & (F.abs("tau") < float("inf"))
        out = out.unionByName(checks(tau.agg(F.every(finite).alias("ok"), F.max("tau").alias("m")), row("times", F.col("ok"), F.col("m"))))
    if balance is not None:
        g = balance.agg(F.max(F.abs(F.col("income") - F.col("expenditure"))).alias("gap"), F.max(F.abs("income")).alias("scale"))
        out = out.unionByName(checks(g, row("income", F.col("gap") < 1e-3 * F.greatest(F.col("scale"), F.lit(1.0)), F.col("gap"))))
    return out
