"""Hedonic index with area effects, and Fay-Herriot shrinkage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def centred(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Controls less their sample means; missing values must be filled before."""
    df = df.withColumns(cols)
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"__{c}") for c in cols}).drop(*[f"__{c}" for c in cols])


def controls(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Centred controls of (area, kind, market, rooms, floor, floors): missing rooms take the median, floors 0, each with an indicator."""
    med = df.agg(F.median("rooms").alias("__m"))
    df = df.crossJoin(F.broadcast(med))
    la = F.ln("area")
    cols = {
        "log_area": la, "log_area2": la * la, "house": (F.col("kind") == "house").cast("double"),
        "mkt_primary": (F.col("market") == "primary").cast("double"), "mkt_unknown": (F.col("market") == "unknown").cast("double"),
        "c_rooms": F.coalesce("rooms", "__m").cast("double"), "has_rooms": F.col("rooms").isNotNull().cast("double"),
        "storey": F.coalesce("floor", F.lit(0)).cast("double"), "has_storey": F.col("floor").isNotNull().cast("double"),
        "bld_floors": F.coalesce("floors", F.lit(0)).cast("double"), "has_bld_floors": F.col("floors").isNotNull().cast("double"),
    }
    return centred(df, cols).drop("__m"), list(cols)


def time_dummies(df: DataFrame, label: str, reference: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the labels but those that end in the reference (else but the last one); labels are few."""
    found = sorted(str(r[0]) for r in df.select(label).distinct().collect() if r[0] is not None)
    left = [x for x in found if not x.endswith(str(reference))]
    left = left[:-1] if left == found else left
    names = [f"t_{i}" for i in range(len(left))]
    return df.withColumns({n: (F.col(label).cast("string") == x).cast("double") for n, x in zip(names, left, strict=True)}), names


def fitted(df: DataFrame, y: str, xs: list[str], area: str, weight: str | None = None, ridge: float = 1e-6, fixed: dict[str, float] | None = None) -> tuple[DataFrame, dict]:
    """(area, theta, d, n) and the controls' coefficients: area effects are absorbed, so only small sums reach the driver.

    theta is the area's mean residual, d its HC1 variance: the share of the area's own rows, of the controls'
    coefficients, and of both together.  fixed: controls with known coefficients, taken off before.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    own = sum((F.col(c) * float(b) for c, b in (fixed or {}).items()), F.lit(0.0))
    g = Window.partitionBy(area)
    mean = lambda c: F.sum(w * F.col(c)).over(g) / F.sum(w).over(g)
    x = df.withColumn(y, F.col(y) - own)
    x = x.select(area, w.alias("__w"), *[F.col(c) for c in [y, *xs]], *[mean(c).alias(f"m_{c}") for c in [y, *xs]])
    z = {c: F.col(c) - F.col(f"m_{c}") for c in [y, *xs]}
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    p = len(xs)

    def matrix(row, prefix):
        out = np.zeros((p, p))
        for i, (a, b) in enumerate(pairs):
            out[xs.index(a), xs.index(b)] = out[xs.index(b), xs.index(a)] = row[f"{prefix}{i}"]
        return out

    row = x.agg(*[F.sum(F.col("__w") * z[a] * z[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(F.col("__w") * z[a] * z[y]).alias(f"y{i}") for i, a in enumerate(xs)], F.sum(F.when(F.col("__w") > 0, 1).otherwise(0)).alias("n"), F.count_distinct(area).alias("k")).first()
    bread = np.linalg.inv(matrix(row, "p") + ridge * np.eye(p)) if p else np.zeros((0, 0))
    beta = bread @ np.array([row[f"y{i}"] for i in range(p)], dtype=float)
    fit = sum((F.col(c) * float(b) for c, b in zip(xs, beta, strict=True)), F.lit(0.0))
    u = z[y] - sum((z[c] * float(b) for c, b in zip(xs, beta, strict=True)), F.lit(0.0))
    x = x.withColumn("__e", F.col(y) - fit).withColumn("__s", (F.col("__w") * u) ** 2)
    meat = matrix(x.agg(F.count("*"), *[F.sum(F.col("__s") * z[a] * z[b]).alias(f"q{i}") for i, (a, b) in enumerate(pairs)]).first(), "q")
    spread = bread @ meat @ bread
    total = F.sum("__w")
    out = x.groupBy(area).agg(
        (F.sum(F.col("__w") * F.col("__e")) / total).alias("theta"), F.count("*").alias("n"), (F.sum("__s") / total ** 2).alias("__o"),
        *[F.first(f"m_{c}").alias(f"__m{i}") for i, c in enumerate(xs)], *[(F.sum(F.col("__s") * z[c]) / total).alias(f"__c{i}") for i, c in enumerate(xs)])
    zero = F.lit(0.0)
    cross = sum((F.col(f"__m{i}") * F.col(f"__c{j}") * float(bread[i, j]) for i in range(p) for j in range(p)), zero)
    shared = sum((F.col(f"__m{i}") * F.col(f"__m{j}") * float(spread[i, j]) for i in range(p) for j in range(p)), zero)
    dof = max(row["n"] - p - row["k"], 1)
    d = (F.col("__o") - 2 * cross + shared) * (row["n"] / dof)
    return out.select(area, "theta", F.greatest(d, F.lit(1e-9)).alias("d"), "n"), dict(zip(xs, beta.tolist(), strict=True))


def variance(theta: np.ndarray, x: np.ndarray, d: np.ndarray, tol: float = 1e-8, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(A, beta, V): Newton steps on sum r^2 / (A + d) = n - p, A at least 1e-8; GLS coefficients and their covariance."""
    n, p = x.shape
    a = max(theta.var() - d.mean(), 1e-6)

    def gls(a):
        wi = 1 / (a + d)
        v = np.linalg.pinv((x * wi[:, None]).T @ x)
        b = v @ ((x * wi[:, None]).T @ theta)
        return b, v, theta - x @ b

    for _ in range(rounds):
        _, _, r = gls(a)
        f = (r**2 / (a + d)).sum() - (n - p)
        step = f / (r**2 / (a + d) ** 2).sum()
        new = max(a + step, 1e-8)
        if abs(new - a) < tol:
            a = new
            break
        a = new
    b, v, _ = gls(a)
    return float(a), b, v


def shrunk(direct: DataFrame, area: str, covariates: list[str]) -> DataFrame:
    """(area, theta_tilde, sd, gamma, index) for a table of areas (theta, d, covariates): areas without data take the synthetic value.

    One row an area reaches the driver (a few thousand); covariates are imputed by their mean, constant ones dropped.
    """
    pdf = direct.select(area, "theta", "d", *covariates).toPandas()
    x = pdf[covariates].astype(float)
    x = x.fillna(x.mean())
    x = x.loc[:, x.std(ddof=0) > 0]
    x = np.column_stack([np.ones(len(x)), x.to_numpy()])
    have = pdf["theta"].notna().to_numpy()
    a, b, v = variance(pdf["theta"].to_numpy(float)[have], x[have], pdf["d"].to_numpy(float)[have])
    mu = x @ b
    lev = np.einsum("ij,jk,ik->i", x, v, x)
    d = pdf["d"].to_numpy(float)
    gamma = np.where(have, a / (a + np.where(have, d, 1.0)), 0.0)
    theta = np.where(have, mu + gamma * (np.nan_to_num(pdf["theta"].to_numpy(float)) - mu), mu)
    var = np.where(have, gamma * np.nan_to_num(d) + lev * (1 - gamma) ** 2, a + lev)
    out = pdf[[area]].assign(theta_tilde=theta, sd=np.sqrt(var), gamma=gamma, index=np.exp(theta))
    return direct.sparkSession.createDataFrame(out)
