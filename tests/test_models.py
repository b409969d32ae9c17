"""Model queries on cells made so that a linear order fails."""

import __spark_entry__ as entry_points
from rillgrid.plans import models_queries


def test_out_of_fold_bounds_ask_the_trees(spark, monkeypatch):
    # cells in the middle of the rain have the label; each district leans to one side by as much as all others lean to the other
    lean = [2, -2, 1, -1, 0]
    rows = []
    for dong, side in enumerate(lean):
        for k in range(400):
            rain = k % 20
            extra = side and rain == (19 if side > 0 else 0) and k // 20 < 5 * abs(side)
            rows.append((f"{dong}_{k}", dong, float(rain), int(5 <= rain <= 14 or bool(extra)), k % 5 == 0))
    cells = spark.createDataFrame(rows, "grid_id string, dong long, mean_rain double, label int, watched boolean")
    monkeypatch.setattr(models_queries, "labelled_cells", lambda r: cells)
    got = entry_points.queries()["ml5_out_of_fold_bounds"](spark, "/root/testdata/sf0.001").first().asDict()
    assert got == {"n": 2000, "cells": 2000, "split_districts": 0, "outside": 0, "better_than_chance": True}
