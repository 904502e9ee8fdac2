"""Platt scaling by Newton's method against the conditions of its optimum."""
import math
import random

import pytest

from msgsieve.models.text_model import platt_fit


def frame(spark, rows):
    return spark.createDataFrame([(float(y), float(m)) for y, m in rows], "label double, margin double")


@pytest.mark.parametrize("scale", [0.02, 1.0, 60.0])
def test_gradient_is_zero_at_the_fit(spark, scale):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        m = rng.gauss(0.3, 1.0)
        rows.append((int(rng.random() < 1 / (1 + math.exp(-(1.7 * m - 0.9)))), m * scale))
    a, b = platt_fit(frame(spark, rows))
    gaps = [(y - 1 / (1 + math.exp(-(a * m + b))), m) for y, m in rows]
    assert abs(sum(g for g, _ in gaps)) < 1e-6 and abs(sum(g * m for g, m in gaps)) < 1e-6 * max(scale, 1)
    assert a * scale == pytest.approx(1.7, abs=0.5)


def test_separable_rows_stay_finite_and_in_order(spark):
    a, b = platt_fit(frame(spark, [(0, -2), (0, -1), (1, 1), (1, 3)]))
    assert math.isfinite(a) and math.isfinite(b) and a > 5


def test_equal_margins_give_the_share(spark):
    a, b = platt_fit(frame(spark, [(1, 0.0)] * 3 + [(0, 0.0)]))
    assert a == 0 and 1 / (1 + math.exp(-b)) == pytest.approx(0.75)
