"""Small tables with planted errors."""
import numpy as np
import pandas as pd

from tenetdq.plans.frame import from_df


def frame_of(spark, data, **kw):
    pdf = pd.DataFrame(data)
    pdf.insert(0, "row_id", range(len(pdf)))
    return from_df(spark.createDataFrame(pdf), "row_id", **kw)


def countries(spark, n=200, bad=(7,), noise=True):
    names = ["France", "Italy", "Japan", "China", "Brazil"]
    parts = {"France": "Europe", "Italy": "Europe", "Japan": "Asia", "China": "Asia", "Brazil": "America"}
    country = [names[i % 5] for i in range(n)]
    continent = [parts[c] for c in country]
    for i in bad:
        continent[i] = "Oceania"
    data = {"country": country, "continent": continent}
    if noise:
        data["noise"] = [f"v{(i * 37) % 50}" for i in range(n)]
    return frame_of(spark, data)


def monotone(spark, seed=0):
    rng = np.random.default_rng(seed)
    ctx = rng.choice(["a", "b"], size=400)
    x = rng.integers(0, 40, size=400)
    offset = np.where(ctx == "a", 0, 100)
    y = 2 * x + offset + rng.integers(0, 3, size=400)
    x[5], y[5] = 38, offset[5]
    return frame_of(spark, {"ctx": ctx, "x": x, "y": y})


def sums(spark, n=300, jump=10.0, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=n), rng.normal(size=n)
    z = x + y
    z[4] += jump
    return frame_of(spark, {"x": x, "y": y, "z": z})


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
