"""Components of levels are found on the cluster; only numbers reach the driver."""

import numpy as np
import pytest

from scatterlake.operators import components
from scatterlake.operators.components import level_components
from scatterlake.operators.fixed_effects import Cells
from scatterlake.plans import catalog


def panels():
    rng = np.random.default_rng(11)
    sparse = np.stack([rng.integers(0, 300, 350), rng.integers(0, 200, 350)], axis=1)
    chain = np.array([[i // 2, (i + 1) // 2] for i in range(999)])
    islands = np.stack([np.repeat(np.arange(40), 30), np.repeat(np.arange(40), 30) * 100 + rng.integers(0, 9, 1200)], axis=1)
    three = np.stack([rng.integers(0, 150, 200), rng.integers(0, 120, 200), rng.integers(0, 90, 200)], axis=1)
    return {"sparse": sparse, "chain": chain, "islands": islands, "three": three, "negative": sparse - 150}


@pytest.mark.parametrize("name", panels())
@pytest.mark.parametrize("way", ["one task", "merged", "stars"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_same_as_on_the_driver(spark, monkeypatch, name, way, kind):
    if way != "one task":
        monkeypatch.setattr(components, "TASK_ROWS", 40)
    if way == "stars":
        monkeypatch.setattr(components, "LOCAL_LEVELS", 0)
    codes = panels()[name]
    names = [f"g{i}" for i in range(codes.shape[1])]
    df = spark.createDataFrame(codes.tolist(), ", ".join(f"{g} long" for g in names)).repartition(3)
    df = df.select(*[df[g].cast(kind).alias(g) for g in names])
    cells = Cells(codes, np.ones(len(codes)))
    assert level_components(df, names, len(codes)) == (cells.components(), int(cells.offset[-1]))


def test_no_row_reaches_the_driver(spark, sf_dir, monkeypatch):
    def refuse(self):
        raise AssertionError("rows are taken to the driver")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toArrow", refuse)
    assert catalog.fe_components(spark, sf_dir).count() == 1
